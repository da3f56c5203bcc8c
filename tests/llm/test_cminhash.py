"""Operator 11: signatures, and classes by brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesieve.llm import cminhash
from pagesieve.llm.queries import QUERIES

MIDDLE = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string"


def words_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    out, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def brute(rows):
    """{doc_id: (n_shingles, component_id, kept)} by comparing sets of strings; returns also the links between different sets."""
    sets = {}
    for i, t in rows:
        ws = words_of(t)
        sets[i] = {tuple(ws[k:k + 4]) for k in range(max(1, len(ws) - 3))} if ws else set()
    label, ids, n = {i: i for i in sets}, sorted(sets), 0

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                n += x != y
                label[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}, n


def result(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


def test_query_by_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text").collect()]
    expected, n = brute(rows)
    assert n >= 5 and result(QUERIES["op11_minhash_near_dedup"](spark, MIDDLE)) == expected


def test_permutations_and_estimates():
    x = np.random.default_rng(3).integers(0, 1 << 63, 100_000, np.uint64)
    assert len(np.unique(cminhash._permute(np.unique(x), 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))) == len(np.unique(x))
    # coordinates agree as often as sets are similar, also for small sets and neighbouring shifts
    for size in (12, 60, 600):
        for common in (0.3, 0.6, 0.9):
            agreed = []
            for seed in range(150):
                draw = np.random.default_rng([seed, size])
                pool = draw.integers(0, 1 << 63, size, np.uint64)
                a = np.concatenate((pool[:round(size * common)], draw.integers(0, 1 << 63, size - round(size * common), np.uint64)))
                agreed.append((cminhash.signature(a) == cminhash.signature(pool)).mean())
            exact = round(size * common) / (2 * size - round(size * common))
            assert abs(np.mean(agreed) - exact) < 0.03 and np.std(agreed) < 1.3 * (exact * (1 - exact) / 160) ** 0.5 + 0.01


def near_copies(seed, groups, copies, length, changes):
    draw = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{draw.randrange(5000)}" for _ in range(length)]
        for c in range(copies):
            own = list(base)
            for _ in range(draw.randrange(changes + 1)):
                own[draw.randrange(length)] = f"own{draw.randrange(10**6)}"
            rows.append((1000 * g + c, " ".join(own)))
    return rows


@pytest.mark.parametrize("tile", [cminhash.TILE, 6])
def test_classes_by_brute_force(spark, tile):
    """Groups whose members are similar to some of their group only, in tiles of any size."""
    rows = near_copies(1, 12, 25, 60, 4) + near_copies(2, 1, 60, 40, 2)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    expected, n = brute(rows)
    assert n > 300 and len({c for _, c, _ in expected.values()}) > 30
    got = result(cminhash.similar_classes(spark.createDataFrame(rows, SCHEMA).repartition(4), tile=tile))
    assert got == expected


def test_templates_are_not_compared_with_each_other(spark):
    """Documents that share most of their words but are no near copies: tiles grow with their number at most."""
    draw = random.Random(7)
    shared = [f"template{i}" for i in range(50)]

    def rows_in_tiles(count):
        rows = [(i, " ".join(shared + [f"own{draw.randrange(10**9)}" for _ in range(20)])) for i in range(count)]
        docs = spark.createDataFrame(rows, SCHEMA)
        sets = {i: cminhash.shingle_set(t.encode()) for i, t in rows}
        ids = {i: cminhash._set_id(s) for i, s in sets.items()}
        distinct = spark.createDataFrame([(ids[i], len(s), cminhash.band_keys(s)) for i, s in sets.items()], "id binary, n int, bands array<bigint>")
        whole = spark.createDataFrame([(ids[i], s.view(np.int64).tolist()) for i, s in sets.items()], "id binary, shingles array<bigint>")
        members = cminhash.bucket_members(distinct)
        assert members.count() > count  # they do share bands
        roots = spark.createDataFrame([], "node binary, root binary")
        assert {r[1:] for r in map(tuple, cminhash.similar_classes(docs).select("doc_id", F.col("doc_id") == F.col("component_id")).collect())} == {(True,)}
        return cminhash.open_tiles(members, whole, roots, 80, 64).count()

    assert rows_in_tiles(400) <= 800 and rows_in_tiles(800) <= 1600


def test_edge_cases(spark):
    long = " ".join(f"word{i % 997} stands{i % 13} here." for i in range(60_000))
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "x"), (4, "X"), (5, "a b c"), (6, "A\tb\nC"), (7, "a b c d"), (8, long), (9, long + " more"),
            (10, "ÄÖ ÜÉ ß 日本語 \U0001F600"), (11, "äÖ ÜÉ ß 日本語 \U0001F600"), (12, "a b c d e f")]
    got = result(cminhash.similar_classes(spark.createDataFrame(rows, SCHEMA)))
    expected, _ = brute(rows)
    assert got == expected
    assert [got[i][0] for i in (0, 1, 2)] == [0, 0, 0] and got[4] == (1, 3, False) and got[9][1:] == (8, False)
    # repeated rows, rows without an id, one id with two texts, clashing columns
    odd = [(5, "one two three four five"), (5, "one two three four five"), (None, "one two three four five"), (None, "alone here"), (7, "alone too"), (7, "One two three four five")]
    docs = spark.createDataFrame(odd, SCHEMA)
    for c in ("id", "n", "bands", "key", "tile", "root", "component_id", "kept", "version", "token", "shingles"):
        docs = docs.withColumn(c, F.lit("own"))
    out = sorted(map(str, map(tuple, cminhash.similar_classes(docs).collect())))
    assert out == sorted(map(str, [(5, 2, 5, True)] * 2 + [(None, 2, 5, False), (None, 1, None, True), (7, 1, 7, True), (7, 2, 5, False)]))
    assert cminhash.similar_classes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert cminhash.similar_classes(spark.createDataFrame([(1, None)], SCHEMA)).collect() == [(1, 0, 1, True)]
