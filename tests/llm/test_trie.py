"""Operator 12 against a trie built in memory."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagesieve.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows, family=20):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            convs[conv].append((turn is not None, turn or 0, role, key, text))
    turns = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (abs(c) % family) * (1 if c >= 0 else -1)
        path = tuple(turns.get(first, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out = {}
    for path in sorted(members, key=len, reverse=True):
        n = len(members[path])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        below = [out[c] for c in children[path]]
        out[path] = (min(members[path]), len(path), min(members[path[:-1]]) if path else None, n, len(below),
                     sum(b[5] for b in below) or 1, sum(b[6] for b in below) + (n - 1) * words,
                     hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest())
    return sorted(out.values(), key=str)


def run(spark, rows, width, family=20):
    df = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), family, width)
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


def some(seed, convs, longest, words=3):
    draw = random.Random(seed)
    return [(c, t, "user" if t % 2 == 0 else "assistant", " ".join(draw.choice("ab") for _ in range(draw.randrange(words))))
            for c in draw.sample(range(-convs, 3 * convs), convs) for t in range(draw.randrange(1, longest + 1))]


@pytest.mark.parametrize("width, longest", [(1, 5), (2, 9), (3, 20), (8, 30)])
def test_by_brute_force(spark, width, longest):
    rows = some(width, 60, longest)
    assert run(spark, rows, width) == brute(rows)


def test_nulls_ties_repeated_rows_and_absent_first_conversation(spark):
    rows = [(21, None, "user", "first"), (21, 0, None, "x y"), (21, 0, "a", None), (21, 0, "a", "z"), (21, 0, "a", "z"), (21, 2, "", ""),
            (None, 0, "user", "nobody's"), (40, 0, "user", "first"), (41, 0, "user", "own"), (47, 5, None, None),
            (-3, 0, "u", "v"), (-20, 0, "u", "v"), (-21, 0, "u", "v"), (-21, 1, "u", "w\t\nx"), (9, 1, "日本", "語 \U0001F600")]
    got = run(spark, rows, 2)
    assert got == brute(rows)
    assert got == run(spark, rows, 8)
    assert run(spark, [], 2) == [] and run(spark, [(None, 0, "user", "nobody's")], 2) == []


def test_conversations_left_without_turns(spark):
    rows = [(c, 0, "user", "one turn") for c in range(21, 40)]  # 20 is absent
    got = run(spark, rows, 8)
    assert got == brute(rows)
    assert max(r[3] for r in got if r[1] == 1) < 19 == next(r[3] for r in got if r[1] == 0)


def test_many_equal_conversations_are_digested_in_pieces(spark, monkeypatch):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 6000, 20) for t in range(3)] + [(7, 0, "user", "turn 0")]
    whole = brute(rows)
    assert run(spark, rows, 2) == whole
    # pieces of any size give the same digest
    ids = [(b"n", i) for i in range(500)] + [(b"o", 1)]
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"node": [a.decode() for a, _ in ids], "conv_id": [b for _, b in ids]})
    monkeypatch.setattr(trie, "CHUNK", 50)
    pieces = list(trie._chunks(iter([batch.slice(0, 100), batch.slice(100)])))
    assert len(pieces) > 20
    digests = {n: d for b in trie._digests(iter(pieces)) for n, d in zip(*b.to_pydict().values())}
    assert digests == {"n": hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest(), "o": hashlib.sha256(b"1").hexdigest()}


def test_a_very_long_conversation_in_few_rounds(spark):
    rows = [(20, t, "user", f"t{t}") for t in range(1500)] + [(40, t, "user", f"t{t}") for t in range(1400)]
    got = run(spark, rows, 8)
    assert len(got) == len(brute(rows)) and got == brute(rows)


def test_prefixes_beyond_a_row_are_cut_below_the_aggregate(spark):
    rows = trie.blocks(trie.rebuild(trie.numbered_turns(spark.createDataFrame(some(1, 5, 4), SCHEMA))), 3)
    plan = trie._rollup(rows, 3, F.count(F.lit(1)).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    lines = [line.strip(" +-:") for line in plan.splitlines()]
    at = next(i for i, line in enumerate(lines) if line.startswith("Expand"))
    assert lines[at - 1].startswith("Filter") and lines[at - 2].startswith("Aggregate")
