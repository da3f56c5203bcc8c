"""MinHash near-duplicate classes whose signatures come from two permutations, one of them shifted round
(numbered operator 11)."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, functions as F

from pagesieve.llm.components import connected_components
from pagesieve.llm.util import map_texts
from pagesieve.operators.skew import skewable_join
from pagesieve.session import materialize

SHINGLE, PERCENT = 4, 80
# Two sets with similarity 0.8 agree in no band in 3 of a million cases; more similar ones in fewer.
BANDS, ROWS = 32, 5
TILE, TILE_SHINGLES = 1024, 1 << 21  # sets that a task compares at once, and their shingles
COLUMNS = 4096  # shingles that a task compares at once
# A side of at most so many narrow rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words of a UTF-8 text, A-Z lower-cased; a shorter text is one
    run, one without words has none."""
    import xxhash

    words = text.lower().split()  # on bytes: A-Z, and blanks \x09-\x0D and \x20
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i:i + size]), 42) for i in range(n)), np.uint64, n))


def _permute(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A permutation of the 64-bit numbers, in place: odd factors and folded high bits can be undone."""
    x *= np.uint64(first)
    x ^= x >> np.uint64(32)
    x *= np.uint64(second)
    x ^= x >> np.uint64(29)
    return x


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Coordinate k is the smallest value over the set of pi(sigma(shingle) - k): sigma shuffles the
    64-bit universe once, and each coordinate uses the same pi, shifted round by one place more."""
    shift = np.arange(size, dtype=np.uint64)
    low = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        places = _permute(shingles[at:at + 1024].copy(), 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
        np.minimum(low, _permute(places[:, None] - shift, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53).min(axis=0), out=low)
    return low


def band_keys(shingles: np.ndarray) -> list[int]:
    """One key per band; an empty set has none."""
    import xxhash

    if not len(shingles):
        return []
    rows = signature(shingles).reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), n) - (1 << 63) for n, r in enumerate(rows)]


def _set_id(shingles: np.ndarray) -> bytes | None:
    return blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _mark(docs: list, texts: list[bytes]) -> list[list]:
    sets = [shingle_set(t) for t in texts]
    return [docs, [_set_id(s) for s in sets], [len(s) for s in sets], [band_keys(s) for s in sets]]


def similar_pairs(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs with that Jaccard similarity, exactly: common shingles are counted for all
    pairs by products of 0/1 matrices, COLUMNS shingles at a time."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[code] > 1  # others are common to no pair
    owner, code = owner[shared], np.unique(code[shared], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common = np.zeros((len(sets), len(sets)), np.int64)
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        lo, hi = np.searchsorted(code, [first, first + COLUMNS])
        held, where = np.unique(owner[lo:hi], return_inverse=True)
        block = np.zeros((len(held), COLUMNS), np.float32)
        block[where, code[lo:hi] - first] = 1
        common[np.ix_(held, held)] += (block @ block.T).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    return np.nonzero(np.triu(100 * common >= percent * union, 1))


def _compare(percent: int):
    """Over rows (tile, id, shingles) with the rows of a tile adjacent: a spanning forest of the similar pairs
    of each tile. One tile is held at a time."""

    def links(ids: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch | None:
        if len(ids) < 2:
            return None
        i, j = similar_pairs(sets, percent)
        root = list(range(len(ids)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for a, b in zip(i.tolist(), j.tolist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((ids[a], ids[b]))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.binary()) for k in (0, 1)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, ids, sets = None, [], []
        for batch in batches:
            shingles = batch["shingles"]
            for n, (t, own) in enumerate(zip(batch["tile"].to_pylist(), batch["id"].to_pylist())):
                if t != tile:
                    if (found := links(ids, sets)) is not None:
                        yield found
                    tile, ids, sets = t, [], []
                ids.append(own)
                sets.append(shingles[n].values.to_numpy())
        if (found := links(ids, sets)) is not None:
            yield found

    return run


def bucket_members(distinct: DataFrame) -> DataFrame:
    """distinct(id, n, bands) to (key, id, n, first, last): the sets that share a band's key with others, and the
    smallest and largest id among them, with its size."""
    keyed = distinct.select(F.explode("bands").alias("key"), "id", "n")
    whole = F.struct("id", "n")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(whole).alias("first"), F.max(whole).alias("last")).filter("m > 1").drop("m")
    return skewable_join(keyed, shared, ["key"], "inner")


def _may_be_similar(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def star_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of the sets of a bucket with its first and last one, confirmed on the whole sets."""
    centres = members.select("id", "n", F.explode(F.array("first", "last")).alias("centre"))
    one, two = F.least("id", "centre.id"), F.greatest("id", "centre.id")
    pairs = centres.filter((one != two) & _may_be_similar(F.col("n"), F.col("centre.n"), percent)).select(two.alias("u"), one.alias("v")).distinct()
    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("b"))
    both = skewable_join(pairs.join(left, "u"), right, ["v"], "inner")
    common = F.size(F.array_intersect("a", "b"))
    return both.filter(100 * common >= percent * (F.size("a") + F.size("b") - common)).select("u", "v")


def open_tiles(members: DataFrame, sets: DataFrame, roots: DataFrame, percent: int, tile: int = TILE) -> DataFrame:
    """(tile, id) for all sets of buckets that the stars left in several classes, so that each similar pair of
    different classes meets in a tile.

    All that is linked over such buckets is a tile if it is no larger than one. Within a larger group,
    two sets can only be that similar if they share one of their rarest shingles (as many as they may differ in,
    and one more), whatever the order of rarity. Sets with such a shingle in common, and of more
    than one class, are a tile; equal tiles count once. A group of more than `tile` sets, or too many shingles, is cut
    by class, size and hash into parts, and pairs of parts are tiles; parts of one large class don't meet.
    """
    classed = members.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("class", F.coalesce("root", "id"))
    undecided = classed.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a != b").select("key")
    rows = materialize(skewable_join(classed, undecided, ["key"], "inner").select("id", "n", "class", F.col("first.id").alias("first")).distinct(), "open")
    group = connected_components(rows.select(F.col("id").alias("u"), F.col("first").alias("v"))).withColumnsRenamed({"node": "id", "root": "group"})
    ids = materialize(rows.select("id", "n", "class").distinct().join(group, "id"), "open")
    sizes = ids.groupBy("group").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("weight")).select(
        "group", ((F.col("m") <= tile) & (F.col("weight") <= TILE_SHINGLES)).alias("fits"))
    whole = skewable_join(ids, sizes.filter("fits").select("group"), ["group"], "inner").select(F.xxhash64("group").alias("tile"), "id")
    ids = skewable_join(ids, sizes.filter("not fits").select("group"), ["group"], "inner").select("id", "n", "class")
    tokens = sets.join(ids, "id").select("id", "n", "class", F.explode("shingles").alias("token"))
    seen = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("seen")).filter("seen > 1")
    # a shingle seen once leads the order, but no other set has it
    ranked = skewable_join(tokens, seen, ["token"], "left").groupBy("id", "n", "class").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("seen", F.lit(1)).alias("seen"), "token"))).alias("tokens"))
    most = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    grouped = materialize(ranked.select("id", "n", "class", F.explode(F.slice("tokens", F.lit(1), most.cast("int"))).alias("t")).filter(
        "t.seen > 1").select(F.col("t.token").alias("token"), "id", "n", "class"), "prefixes")
    groups = grouped.groupBy("token").agg(
        F.count(F.lit(1)).alias("m"), F.sum("n").alias("weight"), F.min("class").alias("a"), F.max("class").alias("b"),
        F.bit_xor(F.xxhash64("id")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("s2")).filter("a != b")
    # groups of the same sets count once
    groups = materialize(groups.groupBy("m", "s1", "s2").agg(F.min("token").alias("token"), F.first("weight").alias("weight")).select(
        "token", ((F.col("m") <= tile) & (F.col("weight") <= TILE_SHINGLES)).alias("small")), "groups")
    small = skewable_join(grouped, groups.filter("small").select("token"), ["token"], "inner").select(F.col("token").alias("tile"), "id")
    large = skewable_join(grouped, groups.filter("not small").select("token"), ["token"], "inner").withColumn(
        "step", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))).cast("int"))
    own_class = large.groupBy("token", "class").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= tile / 2).select(
        "token", "class", F.col("class").alias("kind"))
    large = skewable_join(large, own_class, ["token", "class"], "left").withColumn("kind", F.coalesce("kind", F.lit(b"")))
    need = F.greatest(F.count(F.lit(1)) * 2 / tile, F.sum("n") * 2 / TILE_SHINGLES)
    parts = materialize(large.groupBy("token", "kind", "step").agg(F.ceil(need).cast("int").alias("parts")), "parts")
    mine = skewable_join(large, parts, ["token", "kind", "step"], "inner").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = parts.select("token", F.col("kind").alias("kind2"), F.col("step").alias("step2"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part2"))
    one, two = F.struct("kind", "step", "part"), F.struct(F.col("kind2").alias("kind"), F.col("step2").alias("step"), F.col("part2").alias("part"))
    near = mine.join(other, "token").filter(
        (F.abs(F.col("step") - F.col("step2")) <= 1) & ((F.col("kind") != F.col("kind2")) | (F.col("kind") == F.lit(b""))))
    return whole.unionByName(small).unionByName(near.select(F.xxhash64("token", F.least(one, two), F.greatest(one, two)).alias("tile"), "id"))


def similar_classes(docs: DataFrame, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * common >= percent * all distinct shingles of four words; component_id is
    the smallest doc_id reachable over links, itself included. Documents with equal sets are taken
    together first. Candidates share a band of the signature. Each is compared with the first and the last of its
    bucket; sets that this leaves unconnected are compared with all they may be similar to. Every link is confirmed
    on the whole sets (of 64-bit shingle hashes), and no pair of a bucket is left undecided.

    Null texts and texts without words have n_shingles 0, are linked with nothing and kept. Repeated rows are
    returned as often as they come. A null doc_id names no component: such a row has the smallest
    doc_id that it is linked to, or null, and is kept in the latter case only. An empty table gives no rows.
    """
    version = F.xxhash64("text")
    keyed = docs.select(F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), version.alias("version")).alias("doc_id"), "text")
    marked = materialize(map_texts(keyed, _mark, "doc struct<doc_id:bigint,version:bigint>, id binary, n int, bands array<bigint>"), "sets")
    named = F.struct(F.col("doc.doc_id").isNull(), F.col("doc.doc_id"))
    distinct = materialize(marked.filter("id IS NOT NULL").groupBy("id").agg(
        F.min("doc.doc_id").alias("low"), F.min_by("doc", named).alias("doc"), F.first("n").alias("n"), F.first("bands").alias("bands")), "distinct")
    members = materialize(bucket_members(distinct), "members")
    seen = Observation()
    wanted = materialize(members.select("id").distinct().join(distinct.select("id", "doc"), "id").observe(seen, F.count(F.lit(1)).alias("n")).select(
        "id", F.col("doc.doc_id").alias("_id"), F.col("doc.version").alias("_version")), "wanted")
    if seen.get["n"] <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), version.alias("version"), "text").join(
        wanted, (F.col("version") == F.col("_version")) & F.col("doc_id").eqNullSafe(F.col("_id"))).groupBy("id").agg(F.first("text").alias("text"))
    sets = materialize(map_texts(texts, lambda ids, whole: [ids, [shingle_set(t).view(np.int64) for t in whole]], "id binary, shingles array<bigint>", "id"), "shingles")
    roots = connected_components(star_links(members, sets, percent))
    tiles = open_tiles(members, sets, roots, percent, tile).distinct()
    links = skewable_join(tiles, sets, ["id"], "inner").select("tile", "id", "shingles").repartition("tile").sortWithinPartitions("tile").mapInArrow(
        _compare(percent), "u binary, v binary")
    roots = connected_components(links.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    rooted = distinct.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "low", F.coalesce("root", "id").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_set = skewable_join(rooted, lowest, ["root"], "inner").select("id", "component_id")
    own = skewable_join(marked.select(F.col("doc.doc_id").alias("doc_id"), "id", "n"), by_set, ["id"], "left").select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return own.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
