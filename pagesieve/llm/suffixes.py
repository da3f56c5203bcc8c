"""Removal of repeated byte strings with a sparse suffix array (numbered operator 4).

Of all suffixes only those at anchors are sorted. An anchor is a place whose 20-byte gram has the
smallest hash within some 100-byte window; equal windows have equal anchors, so every repeated
window is found from an anchor within it, though only about one suffix in 36 is kept. An anchor's
context is what windows around it can reach: 80 bytes before and 100 bytes from it.

1. The anchors' suffixes are range-partitioned by sampled splitters over their leading bytes, then
   gram, context and place. Buckets sort by multikey quicksort, and their ends are compared with
   the neighbours'. A suffix whose context was seen earlier is covered throughout; a gram with several
   contexts is left open.
2. Open contexts are fetched from the texts and sorted among those of their gram, forwards and backwards,
   by multikey quicksort; runs of long enough common prefixes give, for each window, the earliest place.

A document is a doc_id and a text. Texts that share a doc_id are told apart by a version, a hash of the text;
documents without such a rival have version 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagesieve.llm.util import slices
from pagesieve.operators.skew import skewable_join
from pagesieve.session import materialize

LENGTH, GRAM = 100, 20
REACH = LENGTH - GRAM  # a window starts at most so far before its anchor
HOT_CONTEXTS = 50_000  # contexts of one gram in a bucket beyond which windows are grouped one by one
SPACING = 36  # bytes from an anchor to the next, about; texts of few different bytes have more anchors
BUCKET_ANCHORS = 1 << 20  # suffixes that a bucket holds, about: there are as many buckets as that takes
SPLITTER_DOCS, SPLITTER_KEYS = 20, 32  # documents sampled and keys drawn per bucket, for splitters only
KEY_BYTES = 48
_BASE = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 20-byte gram, built by doubling."""
    h = b.astype(np.uint64) + np.uint64(1)
    four = None
    for size in (1, 2, 4, 8):
        if size == 4:
            four = h
        h = h[:-size] * _power(size) + h[size:]
    h = h[:-4] * _power(4) + four[16:]
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[:size - width], x[width - size:]) if size < width else x


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of a text's anchors; none if the text is shorter than a window."""
    if len(text) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _gram_hashes(np.frombuffer(text, np.uint8))
    smallest = _sliding(h, REACH + 1, np.minimum)
    edge = np.zeros(REACH, np.uint64)
    at = np.nonzero(_sliding(np.concatenate((edge, smallest, edge)), REACH + 1, np.maximum) == h)[0]
    return at, h[at]


def multikey_sort(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by several columns: rows are sorted by the first, and only those that tie go
    on to the next, within their group of ties."""
    order = np.argsort(columns[0], kind="stable")
    first = columns[0][order]
    tied = np.concatenate(([False], first[1:] == first[:-1]))
    for column in columns[1:]:
        group = np.cumsum(~tied)
        open_ = tied.copy()
        open_[:-1] |= tied[1:]
        rows = np.nonzero(open_)[0]
        if not len(rows):
            break
        part = order[rows]
        inner = np.lexsort((column[part], group[rows]))
        order[rows] = part[inner]
        values, groups = column[order[rows]], group[rows]
        same = np.concatenate(([False], (values[1:] == values[:-1]) & (groups[1:] == groups[:-1])))
        tied[rows] = same
    return order


def _keys(lead: np.ndarray, gram: np.ndarray, context: np.ndarray, doc: np.ndarray, version: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fixed-length byte strings that sort like (lead, gram, context, doc, version, at)."""
    out = np.empty((len(lead), 6), ">u8")
    signed = [c.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for c in (doc, version)]
    for i, column in enumerate((lead, gram, context, *signed, at.astype(np.uint64))):
        out[:, i] = column
    return out.view(f"S{KEY_BYTES}").ravel()


def _suffixes(ids: list, versions: list[int], texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """lead, gram, context, doc, version and at of all anchors of a slice."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    parts = []
    for doc, version, text in zip(ids, versions, texts):
        at, gram = anchors(text)
        if not len(at) or doc is None:
            continue
        places = at.tolist()
        lead = np.frombuffer(b"".join([text[p:p + 8] for p in places]), ">u8").astype(np.uint64)
        # what lies before the anchor's reach differs for a context cut short by the start of the text
        context = np.fromiter((digest(text[max(0, p - REACH):p + LENGTH], min(p, REACH)) for p in places), np.uint64, len(places))
        parts.append((lead, gram, context, np.full(len(at), doc, np.int64), np.full(len(at), version, np.int64), at))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _texts(part: pa.RecordBatch) -> tuple[list, list[int], list[bytes]]:
    return (part.column("doc_id").to_pylist(), part.column("version").to_pylist(),
            part.column("text").cast(pa.binary()).fill_null(b"").to_pylist())


def _with_versions(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """doc_id, version and text of each row; the number of rows with a doc_id, and of their bytes.

    Rivals under one doc_id are found by an aggregate of narrow rows. Only if there are any, they are
    joined to the texts, by broadcast if their table is small."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digest = F.xxhash64("text")
    ids = materialize(docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        (F.min(digest) != F.max(digest)).alias("rivals"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")), "ids")
    seen = ids.agg(F.sum("n"), F.sum("bytes"), F.max("rivals")).first()
    version = F.lit(0).cast("bigint")
    if seen[2]:
        rivals = materialize(ids.filter("rivals").select(F.col("doc_id").alias("_id")), "rivals")
        docs = docs.join(rivals, F.col("doc_id") == F.col("_id"), "left")
        version = F.when(F.col("_id").isNotNull(), digest).otherwise(version)
    return docs.select("doc_id", version.alias("version"), "text"), seen[0] or 0, seen[1] or 0


def _splitters(docs: DataFrame, rows: int, size: int, least: int) -> np.ndarray:
    """Bucket bounds from a sample of documents, for at least `least` buckets of about BUCKET_ANCHORS
    suffixes. They decide where suffixes meet, not whether. The driver gets about SPLITTER_KEYS keys of
    fixed length per bucket."""
    buckets = max(least, size // SPACING // BUCKET_ANCHORS + 1)
    share = min(1.0, (200 + SPLITTER_DOCS * buckets) / max(1, rows))
    every = max(1, int(share * size / SPACING / (SPLITTER_KEYS * buckets)))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                columns = _suffixes(*_texts(part))
                drawn = _keys(*[c[::every] for c in columns]).tobytes()
                keys = [drawn[i:i + KEY_BYTES] for i in range(0, len(drawn), KEY_BYTES)]
                # the first row of a slice tells how many anchors it has
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array([len(columns[0])] * bool(keys) + [0] * (len(keys) - 1), pa.int64())], ["key", "anchors"])

    drawn = docs.sample(share, seed=7) if share < 1 else docs
    found = drawn.mapInArrow(sample, "key binary, anchors bigint").toArrow()
    buckets = max(least, int(sum(found["anchors"].to_pylist()) / share) // BUCKET_ANCHORS + 1)
    keys = np.array(found["key"].to_pylist(), f"S{KEY_BYTES}")
    keys.sort()
    return keys[np.linspace(0, len(keys), buckets + 1).astype(int)[1:-1]] if len(keys) >= buckets else np.unique(keys)


_PACKED = ["docs", "versions", "places", "leads", "grams", "contexts"]
_TYPES = [np.int64, np.int64, np.int32, np.uint64, np.uint64, np.uint64]


def _partition(docs: DataFrame, bounds: np.ndarray) -> DataFrame:
    """bucket and the bucket's suffixes of a slice of documents, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lead, gram, context, doc, version, at = _suffixes(*_texts(part))
                if not len(at):
                    continue
                bucket = np.searchsorted(bounds, _keys(lead, gram, context, doc, version, at), "right")
                order = np.argsort(bucket, kind="stable")
                bucket = bucket[order]
                cuts = np.nonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))[0].tolist() + [len(bucket)]
                columns = [c[order].astype(t) for c, t in zip((doc, version, at, lead, gram, context), _TYPES)]
                packed = [pa.array([c[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), *packed], ["bucket", *_PACKED])

    schema = "bucket int, " + ", ".join(f"{c} binary" for c in _PACKED)
    return docs.mapInArrow(run, schema)


# What a sorted bucket says of a suffix.
COVERED, OPEN, ALONE = 0, 1, 2


def _sort_buckets(packed: DataFrame, buckets: int, hot: int) -> DataFrame:
    """A row per bucket: its first and last suffix, and which suffixes are covered or open.

    The first row of a context is its earliest place in the bucket, the others are covered. Contexts
    are open where their gram has several; of a gram with one context, only the bucket's first and
    last are returned, since a neighbour may hold another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            rows = zip(batch.column("bucket").to_pylist(), *[batch.column(c).to_pylist() for c in _PACKED])
            for bucket, *columns in rows:
                held.setdefault(bucket, []).append(columns)
        for bucket in sorted(held):
            parts = held.pop(bucket)
            doc, version, at, lead, gram, context = (np.frombuffer(b"".join(p[i] for p in parts), t) for i, t in enumerate(_TYPES))
            order = multikey_sort([lead, gram, context, doc, version, at])
            doc, version, at, lead, gram, context = (c[order] for c in (doc, version, at, lead, gram, context))
            new_gram = np.concatenate(([True], (lead[1:] != lead[:-1]) | (gram[1:] != gram[:-1])))
            new_context = new_gram | np.concatenate(([True], context[1:] != context[:-1]))
            firsts = np.nonzero(new_context)[0]
            first = firsts[np.cumsum(new_context) - 1]
            again = ~new_context & ((doc != doc[first]) | (version != version[first]) | (at != at[first]))
            gram_no = np.cumsum(new_gram)[firsts] - 1
            sizes = np.bincount(gram_no)
            state = np.where(sizes[gram_no] > 1, OPEN, ALONE)
            ends = (gram_no == 0) | (gram_no == len(sizes) - 1)
            keep = (state == OPEN) | ends
            whole = len(sizes) == 1
            is_hot = (sizes[gram_no] > hot) | whole & (sizes[gram_no] > 1)
            chosen = firsts[keep]
            covered = np.nonzero(again)[0]
            rows = np.concatenate((covered, chosen))
            states = np.concatenate((np.full(len(covered), COVERED), state[keep] + 4 * is_hot[keep]))
            # 8: of the bucket's first gram, 16: of its last, 32: the bucket's first row
            marks = np.concatenate((np.zeros(len(covered), np.int64), 8 * (gram_no[keep] == 0) + 16 * (gram_no[keep] == len(sizes) - 1) + 32 * (chosen == 0)))
            edge = [gram[0], gram[-1], context[0], context[-1], lead[0], lead[-1]]
            values = [bucket, *[int(np.uint64(e).view(np.int64)) for e in edge], bool(is_hot[0]), bool(is_hot[-1]), bool(is_hot.any()),
                      doc[rows].tobytes(), version[rows].tobytes(), at[rows].astype(np.int32).tobytes(), gram[rows].tobytes(), (states + marks).astype(np.uint8).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(values, types)], names)

    types = [pa.int32(), *[pa.int64()] * 6, *[pa.bool_()] * 3, *[pa.binary()] * 5]
    names = ["bucket", "gram0", "gram1", "context0", "context1", "lead0", "lead1", "hot0", "hot1", "any_hot", "docs", "versions", "places", "grams", "states"]
    schema = "bucket int, " + ", ".join(f"{n} bigint" for n in names[1:7]) + ", " + ", ".join(
        f"{n} boolean" for n in names[7:10]) + ", " + ", ".join(f"{n} binary" for n in names[10:])
    return packed.repartitionById(buckets, F.col("bucket")).mapInArrow(run, schema)


def _compare_ends(sorted_: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, version, at, gram, state of covered and open suffixes, buckets' ends compared with their
    neighbours'; and whether any gram is hot. The driver sees a row of fixed size per bucket."""
    edges = sorted_.select("bucket", "gram0", "gram1", "context0", "context1", "lead0", "lead1", "hot0", "hot1", "any_hot").orderBy("bucket").collect()
    edges = [r.asDict() for r in edges]
    any_hot = any(r["any_hot"] for r in edges)
    # A gram that is hot in one bucket is hot in all that it reaches through whole buckets.
    for ahead, a, b in ((edges, "1", "0"), (edges[::-1], "0", "1")):
        for before, row in zip(ahead, ahead[1:]):
            if (before["lead" + a], before["gram" + a]) == (row["lead" + b], row["gram" + b]) and before["hot" + a]:
                row["hot" + b] = True
                if (row["lead0"], row["gram0"]) == (row["lead1"], row["gram1"]):
                    row["hot0"] = row["hot1"] = True
    told = {}
    for before, row, after in zip([None, *edges], edges, [*edges[1:], None]):
        same_before = before is not None and (before["lead1"], before["gram1"]) == (row["lead0"], row["gram0"])
        same_after = after is not None and (after["lead0"], after["gram0"]) == (row["lead1"], row["gram1"])
        if same_before or same_after:
            told[row["bucket"]] = (same_before, same_before and before["context1"] == row["context0"], row["hot0"],
                                   same_after, row["hot1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, docs, versions, places, grams, states in zip(*[batch.column(c).to_pylist() for c in names]):
                doc, version, at = np.frombuffer(docs, np.int64), np.frombuffer(versions, np.int64), np.frombuffer(places, np.int32)
                gram, state = np.frombuffer(grams, np.int64), np.frombuffer(states, np.uint8).astype(np.int64)
                same_before, seen_before, hot_before, same_after, hot_after = told.get(bucket, (False,) * 5)
                kind, hot = state & 3, (state & 4) > 0
                if same_before:
                    mine = (state & 8) > 0
                    kind[mine & (kind == ALONE)] = OPEN
                    hot |= mine & hot_before
                if same_after:
                    mine = (state & 16) > 0
                    kind[mine & (kind == ALONE)] = OPEN
                    hot |= mine & hot_after
                if seen_before:  # its context began in a bucket before
                    kind[(state & 32) > 0] = COVERED
                keep = kind != ALONE
                out = np.where(kind == OPEN, np.where(hot, 2, 1), 0)[keep]
                for a in range(0, len(out), 65536):
                    z = slice(a, a + 65536)
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array(c[keep][z]) for c in (doc, version, at, gram)], pa.array(out[z].astype(np.int32))],
                        ["doc_id", "version", "at", "gram", "state"])

    names = ["bucket", "docs", "versions", "places", "grams", "states"]
    placed = sorted_.select(*names).mapInArrow(run, "doc_id bigint, version bigint, at int, gram bigint, state int")
    return placed, any_hot


def _contexts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """gram, doc_id, version, at, before, context: the texts around open suffixes. They are packed per document
    to be carried to the texts, which move once."""
    packed = places.select("doc_id", "version", F.struct("at", "gram").alias("place")).groupBy("doc_id", "version").agg(F.collect_list("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out: list[list] = [[], [], [], [], [], []]
                for doc, version, text, found in zip(*_texts(part), part.column("places").to_pylist()):
                    for place in found:
                        p = place["at"]
                        for column, value in zip(out, (place["gram"], doc, version, p, min(p, REACH), text[max(0, p - REACH):p + LENGTH])):
                            column.append(value)
                for a in range(0, len(out[0]), 16384):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[a:a + 16384], t) for c, t in zip(out, (*[pa.int64()] * 3, pa.int32(), pa.int32(), pa.binary()))],
                        ["gram", "doc_id", "version", "at", "before", "context"])

    joined = docs.join(packed, ["doc_id", "version"])
    return joined.mapInArrow(run, "gram bigint, doc_id bigint, version bigint, at int, before int, context binary")


def _common(matrix: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one before it in order; -1 across groups."""
    rows = matrix[order]
    same = rows[1:] == rows[:-1]
    length = np.where(same.all(axis=1), matrix.shape[1], same.argmin(axis=1))
    length[group[order][1:] != group[order][:-1]] = -1
    return np.concatenate(([-1], length))


def _words(matrix: np.ndarray) -> list[np.ndarray]:
    """Eight bytes at a time, as numbers that sort like the bytes."""
    wide = np.zeros((len(matrix), -(-matrix.shape[1] // 8) * 8), np.uint8)
    wide[:, :matrix.shape[1]] = matrix
    numbers = wide.view(">u8").astype(np.uint64)
    return [np.ascontiguousarray(numbers[:, i]) for i in range(numbers.shape[1])]


def _earliest(
    gram: np.ndarray, doc: np.ndarray, version: np.ndarray, at: np.ndarray, before: np.ndarray, contexts: list[bytes]
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows with a window seen earlier in their gram, and the covered stretch around the anchor."""
    n = len(gram)
    order = np.lexsort((at, version, doc))
    gram, doc, version, at, before = (c[order] for c in (gram, doc, version, at, before))
    contexts = [contexts[i] for i in order.tolist()]
    left, right = np.zeros((n, REACH), np.uint8), np.zeros((n, LENGTH), np.uint8)
    after = np.array([len(c) for c in contexts], np.int64) - before
    for i, (c, b) in enumerate(zip(contexts, before.tolist())):
        bytes_ = np.frombuffer(c, np.uint8)
        left[i, :b] = bytes_[:b][::-1]
        right[i, :len(c) - b] = bytes_[b:]
    ranks = []
    for matrix in (right, left):
        by = multikey_sort([gram, *_words(matrix)])
        ranks.append((by, _common(matrix, by, gram)))
    low, high = np.full(n, LENGTH), np.full(n, -1)
    runs = np.empty((2, n), np.int64)
    for offset in range(REACH + 1):
        valid = np.nonzero((before >= offset) & (after >= LENGTH - offset))[0]
        for k, need in ((0, LENGTH - offset), (1, offset)):
            by, common = ranks[k]
            runs[k, by] = np.cumsum(common < need)
        key = runs[0, valid] * (n + 1) + runs[1, valid]
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        origin = valid[first[inverse]]  # rows are in order of place, so the first is the earliest
        seen = (doc[origin] != doc[valid]) | (version[origin] != version[valid]) | (at[origin] != at[valid])
        rows = valid[seen]
        low[rows] = np.minimum(low[rows], offset)
        high[rows] = np.maximum(high[rows], offset)
    rows = np.nonzero(high >= 0)[0]
    return doc[rows], version[rows], at[rows] - high[rows], LENGTH + high[rows] - low[rows]


def _covered_in_groups(contexts: DataFrame) -> DataFrame:
    """doc_id, version, stretch of the windows that an open suffix shares with an earlier one of its gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        columns = [table.column(c).to_numpy().astype(np.int64) for c in ("gram", "doc_id", "version", "at", "before")]
        docs, versions, starts, lengths = _earliest(*columns, table.column("context").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(versions), pa.array(starts << 32 | lengths)], ["doc_id", "version", "stretch"])

    return contexts.repartition("gram").mapInArrow(run, "doc_id bigint, version bigint, stretch bigint")


def _covered_in_windows(contexts: DataFrame) -> DataFrame:
    """The same for grams with too many contexts for one task: each window on its own, by two hashes.
    The earliest place of a window is an aggregate that shrinks before its shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("doc_id", "version", "at", "before", "context")])
            for doc, version, at, before, context in rows:
                starts = list(range(0, min(before, len(context) - LENGTH) + 1))
                digests = [xxhash.xxh3_128_digest(context[s:s + LENGTH]) for s in starts]
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([c] * len(starts), pa.int64()) for c in (doc, version)], pa.array([at - before + s for s in starts], pa.int64()),
                     pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc_id", "version", "start", "h1", "h2"])

    windows = contexts.select("doc_id", "version", "at", "before", "context").mapInArrow(
        run, "doc_id bigint, version bigint, start bigint, h1 bigint, h2 bigint")
    place = F.struct("doc_id", "version", "start")
    earliest = windows.groupBy("h1", "h2").agg(F.min(place).alias("origin"))
    again = skewable_join(windows, earliest, ["h1", "h2"], "inner").filter(place != F.col("origin"))
    return again.select("doc_id", "version", (F.shiftleft("start", 32) + F.lit(LENGTH)).alias("stretch"))


def repeated_stretches(docs: DataFrame, rows: int, size: int, hot: int = HOT_CONTEXTS) -> DataFrame:
    """docs(doc_id, version, text), with so many rows and bytes, to doc_id, version, stretch: place * 2^32 +
    length of repeated bytes; length 0 stands for an anchor's whole context. Stretches overlap."""
    docs = docs.filter(F.col("doc_id").isNotNull())
    bounds = _splitters(docs, rows, size, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = materialize(_sort_buckets(_partition(docs, bounds), len(bounds) + 1, hot), "buckets")
    placed, any_hot = _compare_ends(sorted_)
    whole = placed.filter(F.col("state") == 0).select("doc_id", "version", F.shiftleft(F.col("at").cast("bigint"), 32).alias("stretch"))
    found = whole.unionByName(_covered_in_groups(_contexts(docs, placed.filter(F.col("state") == 1))))
    if any_hot:
        found = found.unionByName(_covered_in_windows(_contexts(docs, placed.filter(F.col("state") == 2))))
    return found


def _remove(text: bytes, stretches: list[int]) -> tuple[int, int, bytes]:
    """Removed bytes, runs of them, and the rest."""
    if not stretches:
        return 0, 0, text
    packed = np.array(stretches, np.int64)
    start, length = packed >> 32, packed & 0xFFFFFFFF
    end = np.minimum(np.where(length == 0, start + LENGTH, start + length), len(text))
    start = np.where(length == 0, np.maximum(start - REACH, 0), start)
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, np.minimum(start, len(text)), 1)
    np.add.at(change, end, -1)
    gone = np.cumsum(change[:-1]) > 0
    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, hot: int = HOT_CONTEXTS) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    Each byte is removed that lies in a 100-byte string which also starts earlier, in a document
    with a smaller doc_id or further to the front of the same one; matches may overlap and are
    judged on the input. A null text is empty; a row with a null doc_id stays whole and covers
    nothing. Equal rows of doc_id and text are one document: they do not cover each other and are cut alike.
    Different texts under one doc_id are documents of their own, of which the one with the smaller hash
    is earlier. Texts under 100 bytes stay whole, and an empty table gives no rows.
    """
    docs, rows, size = _with_versions(docs)
    packed = repeated_stretches(docs, rows, size, hot).groupBy("doc_id", "version").agg(F.collect_list("stretch").alias("stretches"))
    joined = docs.join(packed, ["doc_id", "version"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, _, texts = _texts(part)
                cut = [_remove(t, s or []) for t, s in zip(texts, part.column("stretches").to_pylist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([c[0] for c in cut], pa.int64()),
                    pa.array([c[1] for c in cut], pa.int64()), pa.array([hashlib.sha256(c[2]).hexdigest() for c in cut]),
                    pa.array([c[2] for c in cut], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
