"""Benchmark decontamination by size-partitioned MinHash containment (numbered operator 8). Column
functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from pagesieve.functions.common import let
from pagesieve.operators.skew import skewable_join
from pagesieve.session import materialize

SHINGLE, CONTAINMENT = 5, 0.8
WORDS = r"[\p{L}\p{N}]+"
# A side of at most so many narrow rows (tens of MB) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def _grams(ws: Column, size: int, make) -> Column:
    """make(word, ...) for each run of `size` words; no element if there are fewer."""
    last = F.size(ws) - size
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: make(*[F.get(ws, i + k) for k in range(size)]))
    return F.when(last >= 0, runs).otherwise(F.expr("array()"))


def _hash(*ws: Column) -> Column:
    return F.xxhash64(F.lit(len(ws)), *ws)


def _text(*ws: Column) -> Column:
    return F.concat_ws(" ", *ws)


def _whole_lines(text: Column, size: int, make) -> Column:
    """make(word, ...) for each line of just `size` words."""
    lines = F.filter(F.transform(F.split(text, "\n"), words), lambda ws: F.size(ws) == size)
    return F.transform(lines, lambda ws: make(*[F.get(ws, F.lit(k)) for k in range(size)]))


def _all_grams(text: Column, sizes: list[int], make) -> Column:
    """What items of these sizes are compared with: shingles, for short items whole lines."""
    short = [_whole_lines(text, n, make) for n in sizes if n < SHINGLE]
    long = [let(words(text), lambda ws: _grams(ws, SHINGLE, make))] if SHINGLE in sizes else []
    return F.concat(*short, *long)


def _measured(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    seen = Observation()
    stored = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return stored, seen.get["n"]


def benchmark_items(items: DataFrame) -> DataFrame:
    """item_id, size (words of a shingle), shingles (distinct strings), n. Items of fewer than
    five words are one shingle of all their words, held only by a line of just these words; items
    without words are left out."""
    ws = words(F.col("text"))
    sized = items.select("item_id", ws.alias("ws")).filter(F.size("ws") > 0).withColumn(
        "size", F.least(F.size("ws"), F.lit(SHINGLE)))
    shingles = F.coalesce(*[F.when(F.col("size") == n, F.array_distinct(_grams(F.col("ws"), n, _text)))
                            for n in range(1, SHINGLE + 1)])
    return sized.select("item_id", "size", shingles.alias("shingles")).withColumn("n", F.size("shingles"))


def sketches(items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """item_id, hash: the MinHash sketch of each item, its smallest shingle hashes.

    Items are partitioned by size into classes that end at a power of two; all items of a class
    have sketches of one length, the class bound's share of shingles that may be missing, and one
    more. So a document that holds the asked share of an item's shingles holds at least one
    of its sketch, whatever the document's length: no such pair is lost.
    """
    bound = F.pow(F.lit(2), F.ceil(F.log2("n")))
    length = (F.floor(bound * (1 - containment) + 1e-9) + 1).cast("int")
    hashes = F.transform("shingles", lambda s: F.xxhash64(F.size(F.split(s, " ")), s))
    return items.select("item_id", F.explode(F.slice(F.array_sort(hashes), F.lit(1), length)).alias("hash"))


def contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, version, item_id, containment: documents that hold at least `containment` of an
    item's distinct shingles of five words (A-Z and other letters lower-cased, punctuation
    ignored; containment is exact). version is a hash of the text. An item of fewer words says too
    little to be told from ordinary text: it counts as held where it is a whole line of the document.

    The search joins the hash of every shingle of every document with the items' sketches, which
    are broadcast when counted small. Candidates are then verified on the shingles themselves.
    A null text has no shingle; a row with a null doc_id is searched like any other; rows that
    share doc_id and text give one row per item; items that share an item_id count apart.
    """
    items = materialize(benchmark_items(benchmark), "items")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # five values at most
    if not sizes:
        sizes = [SHINGLE]
    sketch, n_sketch = _measured(sketches(items, containment), "sketches")
    if n_sketch <= BROADCAST_ROWS:
        sketch = F.broadcast(sketch)
    version = F.xxhash64("text").alias("version")
    # The hash of a shingle is that of its words joined by a blank, with its number of words.
    hashed = docs.filter(F.col("text").isNotNull()).select(
        "doc_id", version, F.explode(_all_grams(F.col("text"), sizes, lambda *w: F.xxhash64(F.lit(len(w)), _text(*w)))).alias("hash"))
    found = hashed.join(sketch, "hash").select("doc_id", "version", "item_id").distinct()
    candidates, n_candidates = _measured(found, "candidates")
    pairs = candidates.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "item_id")
    if n_candidates <= BROADCAST_ROWS:
        pairs = F.broadcast(pairs)
    texts = docs.select("doc_id", version, "text")
    held = texts.join(pairs, (F.col("version") == F.col("_version")) & F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id", "_version")
    named = items.withColumnRenamed("item_id", "named_id")
    joined = held.join(named, held["item_id"].eqNullSafe(named["named_id"]))
    own = F.coalesce(*[F.when(F.col("size") == n, _all_grams(F.col("text"), [n], _text)) for n in sizes])
    share = F.size(F.array_intersect("shingles", own)) / F.col("n")
    return joined.select("doc_id", "version", "item_id", share.alias("containment")).filter(
        F.col("containment") >= containment).distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """docs without the documents that hold an item; the columns are those of docs."""
    hit = contaminated(docs, benchmark, containment).select(
        F.col("doc_id").alias("hit_id"), F.col("version").alias("hit_version")).distinct()
    same = (F.xxhash64(docs["text"]) == hit["hit_version"]) & docs["doc_id"].eqNullSafe(hit["hit_id"])
    return docs.join(hit, same, "left_anti")
