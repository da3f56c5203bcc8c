"""SimHash fingerprints and exact near-duplicate classes (numbered operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagesieve.llm.components import connected_components
from pagesieve.llm.util import map_texts
from pagesieve.operators.skew import skewable_join
from pagesieve.session import materialize

RADIUS = 2
BLOCKS = 4
# Fingerprints of one tile; larger groups are cut into tiles by population count.
TILE = 4096


def fingerprint(text: bytes, size: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text, as a signed integer; 0 without words."""
    import xxhash

    words = text.lower().split()  # on bytes: A-Z, and blanks \x09-\x0D and \x20
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    ends -= 1
    n = max(1, len(words) - size + 1)
    spans = zip(starts[:n].tolist(), ends[len(words) - n:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in spans), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        bits = np.unpackbits(hashes[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    value = int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (bigint): the fingerprint of each whole text, null or blank texts 0."""
    return map_texts(docs, lambda ids, texts: (ids, [fingerprint(t) for t in texts]), "doc_id bigint, fp bigint")


class _Forest:
    """Union by smallest index over arrays of pairs."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            low = np.minimum(x, y)
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            while not np.array_equal(nxt := label[label], label):
                label = nxt
            self.label = label


def _tile_pair(fps: np.ndarray, pops: np.ndarray, a0: int, a1: int, b0: int, b1: int, radius: int, forest: _Forest) -> None:
    """Compare rows a0:a1 with b0:b1 (sorted by population count), 256 at a time."""
    for at in range(a0, a1, 256):
        end = min(at + 256, a1)
        # rows of b whose population count can be within the radius
        lo = b0 + np.searchsorted(pops[b0:b1], pops[at] - radius, "left")
        hi = b0 + np.searchsorted(pops[b0:b1], pops[end - 1] + radius, "right")
        lo = max(lo, at) if (a0, a1) == (b0, b1) else lo
        if lo >= hi:
            continue
        near = np.bitwise_count(fps[at:end, None] ^ fps[None, lo:hi]) <= radius
        i, j = np.nonzero(near)
        forest.add(i + at, j + lo)


def _links(fps: np.ndarray, side: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among one tile, or between side 0 and side 1."""
    pops = np.bitwise_count(fps).astype(np.int64)
    order = np.lexsort((pops,) if side is None else (pops, side))
    fps, pops = fps[order], pops[order]
    forest = _Forest(len(fps))
    cut = len(fps) if side is None else int((side == 0).sum())
    if side is None:
        _tile_pair(fps, pops, 0, cut, 0, cut, radius, forest)
    else:
        _tile_pair(fps, pops, 0, cut, cut, len(fps), radius, forest)
    moved = np.nonzero(forest.label != np.arange(len(fps)))[0]
    return fps[moved], fps[forest.label[moved]]


def _compare(radius: int):
    """Over rows (key, side, fp) with the rows of a key adjacent. A partition's narrow rows are
    held as arrays; small groups are compared together, by distance in the row order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "side", "fp")) for b in batches]
        if not parts:
            return
        key, side, fp = (np.concatenate([p[i] for p in parts]) for i in range(3))
        fp = fp.view(np.uint64)
        starts = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0]
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        out = []
        small = np.repeat(sizes <= 64, sizes) & np.repeat(sizes > 1, sizes)
        rows = np.nonzero(small)[0]
        for step in range(1, 64):
            rows = rows[rows + step < len(key)]
            rows = rows[key[rows] == key[rows + step]]
            if not len(rows):
                break
            crossing = (side[rows] < 0) | (side[rows] != side[rows + step])
            near = crossing & (np.bitwise_count(fp[rows] ^ fp[rows + step]) <= radius)
            if near.any():
                out.append((fp[rows[near]], fp[rows[near] + step]))
        for at, size in zip(starts[sizes > 64], sizes[sizes > 64]):
            group, sides = fp[at:at + size], side[at:at + size]
            out.append(_links(group, None if sides[0] < 0 else sides, radius))
        for u, v in out:
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return run


def _block_keys(fp, radius: int, blocks: int):
    """One key per choice of blocks - radius blocks: fingerprints within the radius agree on one."""
    width = 64 // blocks
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << width) - 1) << (b * width) for b in chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(mask))))
    return F.explode(F.array(*keys))


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """distinct(fp) to links (u, v): every pair within the radius is connected through them.

    Two fingerprints that differ in at most `radius` bits agree on `blocks - radius` of the
    blocks, so only fingerprints that share such a key meet. A key's fingerprints form one tile,
    compared by exclusive-or and bit counts; a key with more than `tile` of them is cut by
    population count and hash into tiles, and only tile pairs whose population counts differ by at most
    the radius are made, each a task's unit of its own. A tile yields a spanning
    forest of its links, never the links themselves.
    """
    keyed = distinct.select(_block_keys(F.col("fp"), radius, blocks).alias("key"), "fp")
    count = keyed.groupBy("key").count()
    keyed = materialize(keyed, "blockkeys")
    hot = (keyed.withColumn("pop", F.bit_count("fp")).groupBy("key", "pop").agg(F.count(F.lit(1)).alias("n"))
           .join(count.filter(F.col("count") > tile).select("key"), "key", "left_semi"))
    hot = materialize(hot.withColumn("parts", F.ceil(F.col("n") / tile).cast("int")), "hot")
    hot_keys = hot.select("key").distinct()
    if hot.isEmpty():
        tiles = keyed.select("key", F.lit(-1).alias("side"), "fp")
    else:
        cold = keyed.join(hot_keys, "key", "left_anti").select("key", F.lit(-1).alias("side"), "fp")
        own = keyed.withColumn("pop", F.bit_count("fp")).join(hot.select("key", "pop", "parts"), ["key", "pop"]).withColumn(
            "part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        other = hot.select("key", F.col("pop").alias("pop2"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part2"))
        # each fingerprint goes to the tile pairs of its tile, in which it is the lower or the upper side
        near = own.join(other, "key").filter(F.abs(F.col("pop") - F.col("pop2")) <= radius)
        mine, theirs = F.struct("pop", "part"), F.struct(F.col("pop2").alias("pop"), F.col("part2").alias("part"))
        pair = near.select(
            F.xxhash64("key", F.least(mine, theirs), F.greatest(mine, theirs)).alias("key"),
            F.when(mine == theirs, -1).when(mine < theirs, 0).otherwise(1).alias("side"), "fp")
        tiles = cold.unionByName(pair)
    return tiles.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(radius), "u bigint, v bigint")


def _classes(marked: DataFrame, radius: int) -> DataFrame:
    """Adds component_id, the smallest doc_id reachable, to rows with doc_id and fp."""
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = connected_components(fingerprint_links(distinct.select("fp"), radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = skewable_join(named, lowest, ["root"], "inner").select("fp", "component_id")
    return skewable_join(marked, by_fp, ["fp"], "inner")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs(doc_id, text) to doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that is reachable over links of at most `radius`
    differing bits. Null and blank texts have fingerprint 0 and are linked like others; repeated
    rows are returned as often as they come; a null doc_id never names a component, so a
    component of such rows only has a null one. An empty table gives no rows.
    """
    return _classes(materialize(fingerprints(docs), "fingerprints"), radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id. Columns are those of docs.

    Rows with a null doc_id stay; so do repeated rows of a document that stays. Of rows that share a
    doc_id but not the text, each goes or stays with its own text's component.
    """
    version = F.xxhash64("text")
    keyed = docs.select(F.struct("doc_id", version.alias("version")).alias("doc_id"), "text")
    marked = materialize(map_texts(keyed, lambda ids, texts: (ids, [fingerprint(t) for t in texts]),
                                   "doc struct<doc_id:bigint,version:bigint>, fp bigint").select("doc.*", "fp"), "fingerprints")
    gone = _classes(marked, radius).filter(F.col("doc_id") != F.col("component_id")).select(
        F.col("doc_id").alias("gone_id"), F.col("version").alias("gone_version")).distinct()
    same = (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_version"])
    return docs.join(gone, same, "left_anti")
