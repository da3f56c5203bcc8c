"""HTML to text. Pages are parsed once per row by an Arrow map without a shuffle; selection,
joining, thresholds and the fallback ladder are Spark columns."""

from __future__ import annotations

import os
import pickle
import select
import signal
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager, suppress
from time import monotonic, perf_counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pagesieve import constants as C
from pagesieve.functions import dom
from pagesieve.functions.common import let
from pagesieve.functions.text import clean_markdown, collapse_newlines, normalize_chunks, strip
from pagesieve.functions.urls import url_host
from pagesieve.operators.segments import drop_repeated_segments
from pagesieve.session import materialize

_PAGES_AT_ONCE = 256
NO_CONTENT = "Could not find main content."


def _small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of a few hundred pages: the parsed form of a batch is far larger than its html."""
    for batch in batches:
        for start in range(0, batch.num_rows, _PAGES_AT_ONCE):
            yield batch.slice(start, _PAGES_AT_ONCE)


def parse_pages(
    pages: DataFrame, nodes: bool = True, markdown: bool = False, selectors: Sequence[str] = (), mode: str | None = None,
    md_tags: Sequence[str] = C.MARKDOWN_DROP_TAGS,
) -> DataFrame:
    """Adds `nodes` (text nodes with the elements around them), `found` (content regions of the
    page) and `md` (Markdown) as asked. The html column goes in and does not come back. Filter
    rejected pages first: nothing below is skipped for them. With `mode`, the name of a column,
    Markdown is rendered only for the rows in full mode."""
    classes = frozenset(s[1:] for s in selectors if s.startswith("."))
    ids = frozenset(s[1:] for s in selectors if s.startswith("#"))
    region_drop, md_drop = dom.mask(C.ARTICLE_DROP_TAGS), frozenset(md_tags)
    kept = [f for f in pages.schema.fields if f.name != "html"]
    names, fields = [f.name for f in kept], list(kept)
    if nodes:
        fields += [T.StructField("found", T.IntegerType()), T.StructField("nodes", T.ArrayType(
            T.StructType([T.StructField("text", T.StringType()), T.StructField("inside", T.IntegerType())])))]
    if markdown:
        fields.append(T.StructField("md", T.StringType()))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small_batches(batches):
            html = [h or "" for h in batch.column("html").to_pylist()]
            columns = [batch.column(n) for n in names]
            if nodes:
                offsets, texts, inside, regions = [0], [], [], []
                for page in html:
                    t, b, found = dom.text_nodes(page, region_drop, classes, ids)
                    texts += t
                    inside += b
                    regions.append(found)
                    offsets.append(len(texts))
                items = pa.StructArray.from_arrays(
                    [pa.array(texts, pa.string()), pa.array(inside, pa.int32())], ["text", "inside"]
                )
                columns += [pa.array(regions, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)]
            if markdown:
                full = [m == "full" for m in batch.column(mode).to_pylist()] if mode else [True] * len(html)
                rendered = [dom.to_markdown(page, md_drop, classes, ids) if f else None for page, f in zip(html, full)]
                columns.append(pa.array(rendered, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return pages.mapInArrow(parse, T.StructType(fields))


def _texts(nodes: Column, keep: Callable[[Column], Column]) -> Column:
    kept = F.filter(nodes, lambda n: keep(n["inside"]))
    return F.array_join(F.transform(kept, lambda n: n["text"]), "\n")


def stripped_text(nodes: Column) -> Column:
    """All text outside the dropped elements."""
    drop = dom.mask(C.STRIPPED_DROP_TAGS)
    return strip(collapse_newlines(_texts(nodes, lambda inside: inside.bitwiseAND(drop) == 0)))


def article_text(nodes: Column, found: Column, noise: bool = False) -> Column:
    """Text of the first article, else main, else body; null when the page has none of them."""
    drop = dom.mask(C.ARTICLE_DROP_TAGS) | (dom.TAG_BITS["noise"] if noise else 0)
    region = F.when(F.lit(False), F.lit(0))
    for name in ("article", "main", "body"):
        region = region.when(found.bitwiseAND(dom.TAG_BITS[name]) != 0, F.lit(dom.TAG_BITS[name]))
    # The region is worked out once per page, not once per node.
    text = let(region, lambda r: _texts(nodes, lambda inside: (inside.bitwiseAND(r) != 0) & (inside.bitwiseAND(drop) == 0)))
    return F.when(region.isNotNull(), collapse_newlines(normalize_chunks(text)))


def markdown_text(md: Column) -> Column:
    return strip(collapse_newlines(md))


def _long_enough(text: Column) -> Column:
    return F.when(F.length(text) > C.MIN_EXTRACT_CHARS, text)


def extract_markdown(pages: DataFrame) -> DataFrame:
    """Adds text: Markdown of the page, null unless longer than the acceptance bound."""
    parsed = parse_pages(pages, nodes=False, markdown=True)
    rendered = parsed.withColumn("text", markdown_text(F.col("md"))).drop("md")
    return rendered.withColumn("text", _long_enough(F.col("text")))


def extract_stripped(pages: DataFrame) -> DataFrame:
    """Adds text: every text node outside scripts, navigation, headers and the like."""
    return parse_pages(pages).withColumn("text", stripped_text(F.col("nodes"))).drop("nodes", "found")


def extract_article(pages: DataFrame) -> DataFrame:
    """Adds text: the main content region in trimmed, non-empty lines."""
    text = F.coalesce(article_text(F.col("nodes"), F.col("found")), F.lit(NO_CONTENT))
    return parse_pages(pages).withColumn("text", text).drop("nodes", "found")


def drop_noise(
    pages: DataFrame, tags: Sequence[str] = C.NOISE_TAGS_LONG, selectors: Sequence[str] = C.NOISE_SELECTORS_LONG
) -> DataFrame:
    """Adds text: all text outside the given tags and outside elements matching a selector."""
    drop = dom.mask(list(tags)) | dom.TAG_BITS["noise"]
    text = strip(collapse_newlines(_texts(F.col("nodes"), lambda inside: inside.bitwiseAND(drop) == 0)))
    return parse_pages(pages, selectors=selectors).withColumn("text", text).drop("nodes", "found")


def noise_free_markdown(
    pages: DataFrame, tags: Sequence[str] = C.NOISE_TAGS_SHORT, selectors: Sequence[str] = C.NOISE_SELECTORS_SHORT
) -> DataFrame:
    """Adds text: cleaned Markdown of the page without the given tags and elements matching a selector."""
    rendered = parse_pages(pages, nodes=False, markdown=True, selectors=selectors, md_tags=[*C.MARKDOWN_DROP_TAGS, *tags])
    return rendered.withColumn("text", clean_markdown(markdown_text(F.col("md")))).drop("md")


def extract_main(pages: DataFrame, min_pages: int = 3, key: str = "page_id") -> DataFrame:
    """Adds text: the main content without lines repeated across the host's pages, null unless
    longer than the acceptance bound."""
    parsed = parse_pages(pages).withColumn("text", article_text(F.col("nodes"), F.col("found")))
    stored = materialize(parsed.drop("nodes", "found").withColumn("host", url_host(F.col("url"))), "main")
    deduped = drop_repeated_segments(stored, key, min_pages)
    stripped = deduped.withColumn("text", strip(F.col("text"))).drop("host")
    return stripped.withColumn("text", _long_enough(F.col("text")))


def extract(
    pages: DataFrame, mode: str | None = "precision", min_pages: int | None = 3, mode_column: str | None = None,
    key: str = "page_id",
) -> DataFrame:
    """The ladder. full: Markdown, main content, stripped text. precision: the same without
    Markdown. Adds method and text. Cutting tags by pattern (text.strip_tags_regex) is the
    step for pages that cannot be parsed; the parser here takes any text.

    mode_column names a column with each row's own mode instead. One parse feeds every step. The repeated-line step needs a shuffle of the lines; with
    min_pages=None it is left out and the whole ladder is one shuffle-free stage.
    """
    full = mode_column is not None or (mode is not None and mode.strip().lower() == "full")
    parsed = parse_pages(pages, nodes=True, markdown=full, mode=mode_column)
    nodes, kept = F.col("nodes"), [c for c in pages.columns if c != "html"]
    candidates = parsed.select(
        *kept, article_text(nodes, F.col("found")).alias("main"), stripped_text(nodes).alias("rest"),
        (markdown_text(F.col("md")) if full else F.lit(None).cast("string")).alias("markdown"),
    )
    if min_pages is not None:
        lines = candidates.withColumn("host", url_host(F.col("url"))).withColumnRenamed("main", "text")
        kept_lines = drop_repeated_segments(materialize(lines, "ladder"), key, min_pages)
        candidates = kept_lines.withColumnRenamed("text", "main").drop("host")
    # One projection per step: a column used several times is computed once.
    sized = candidates.withColumn("main", strip(F.col("main")))
    accepted = sized.withColumns({c: _long_enough(F.col(c)) for c in ("markdown", "main")})
    method = F.when(F.col("markdown").isNotNull(), "markdown").when(F.col("main").isNotNull(), "main").otherwise("stripped")
    return accepted.select(*kept, method.alias("method"), F.coalesce("markdown", "main", "rest").alias("text"))


class OverTime(BaseException):
    """Ends a call over its limit; no `except Exception` of the called function holds it up."""


@contextmanager
def _limit(seconds: float | None) -> Iterator[None]:
    """An interval timer that ends the block by OverTime. It fires again until the block is left, in case the
    first one is swallowed."""
    if seconds is None:
        yield
        return

    def over(signum, frame):
        raise OverTime

    before = signal.signal(signal.SIGALRM, over)
    try:
        signal.setitimer(signal.ITIMER_REAL, seconds, 0.05)
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def _guarded_call(fn: Callable, html: str, mode: str, seconds: float | None) -> tuple[object, str | None]:
    """(result, error) of fn(html, mode)."""
    try:
        try:
            with _limit(seconds):
                result = fn(html, mode)
            return result, C.NO_RESULT if result is None else None
        except Exception as exc:  # the caller's function may fail in any way
            return None, str(exc)[:200]
    except OverTime:
        return None, f"Timeout after {seconds:.1f}s"


def _in_child(fn: Callable, html: str, mode: str, seconds: float) -> tuple[object, str | None]:
    """The same in a process of its own, for functions that no signal reaches (native code that does not return,
    a blocked signal). It is killed when its time is over."""
    receive, send = os.pipe()
    child = os.fork()
    if not child:
        try:
            os.close(receive)
            with os.fdopen(send, "wb") as out:
                result, error = _guarded_call(fn, html, mode, None)
                pickle.dump((result[0] if isinstance(result, tuple) else result, error), out)
        except BaseException:  # nothing of the child may run on as the worker
            os._exit(1)
        os._exit(0)
    os.close(send)
    said, deadline = bytearray(), monotonic() + seconds
    try:
        with os.fdopen(receive, "rb", buffering=0) as answer:
            while (left := deadline - monotonic()) > 0 and select.select([answer], [], [], left)[0]:
                piece = answer.read(1 << 16)
                if not piece:
                    return pickle.loads(said) if said else (None, "Extractor process died")
                said += piece
        return None, f"Timeout after {seconds:.1f}s"
    finally:
        with suppress(ProcessLookupError):
            os.kill(child, signal.SIGKILL)
        os.waitpid(child, 0)


def apply_extractor(
    df: DataFrame, fn: Callable[[str, str], str | tuple | None], name: str, mode: str = "precision",
    limit_ms: int | None = None, isolate: bool = False,
) -> DataFrame:
    """Run a user extractor fn(html, mode) on every row and log it as an attempt: adds tier,
    success, content, content_length, elapsed_ms and error. An exception becomes the error.

    limit_ms, by default the limit of the tier of that name if there is one, ends a call that takes longer
    as a failed attempt, `Timeout after 7.0s`; the rows after it are not harmed. The limit is a timer
    signal in the task's own process, which interrupts Python code and waiting calls. With
    `isolate` each call has a process of its own, which is killed: for native code that never returns to Python.
    """
    limit = C.TIER_CAPS_MS.get(name, C.HANDLER_CAPS_MS.get(name)) if limit_ms is None else limit_ms
    if isolate and limit is None:
        raise ValueError("isolate needs a limit")
    seconds = None if limit is None else limit / 1000
    kept = [f for f in df.schema.fields if f.name != "html"]
    schema = T.StructType(kept + [
        T.StructField("tier", T.StringType()), T.StructField("success", T.BooleanType()),
        T.StructField("content", T.StringType()), T.StructField("content_length", T.LongType()),
        T.StructField("elapsed_ms", T.LongType()), T.StructField("error", T.StringType()),
    ])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small_batches(batches):
            rows: list[tuple] = []
            for html in batch.column("html").to_pylist():
                start = perf_counter()
                result, error = (_in_child if isolate else _guarded_call)(fn, html, mode, seconds)
                took = round((perf_counter() - start) * 1000)
                content = result[0] if isinstance(result, tuple) else result
                chars = len(content) if content else 0
                if error and error.startswith("Timeout after") and limit is not None:
                    took = max(took, limit)
                rows.append((name, chars > 0, content, chars, took, error))
            new = list(zip(*rows)) if rows else [()] * 6
            types = [pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            columns = [batch.column(n) for n in names] + [pa.array(c, t) for c, t in zip(new, types)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.mapInArrow(run, schema)
