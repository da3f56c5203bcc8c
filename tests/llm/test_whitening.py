"""Operator 13 against plain integer and matrix computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesieve.llm import whitening
from pagesieve.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def plain(rows):
    """(vec_id, x) of usable rows, n, S and the covariance in exact integers (times n^2)."""
    good = [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    n, dims = len(good), len(good[0][1])
    s = [sum(x[d] for _, x in good) for d in range(dims)]
    scatter = [[n * sum(x[a] * x[b] for _, x in good) - s[a] * s[b] for b in range(dims)] for a in range(dims)]
    return good, n, s, scatter


def check(df, rows, components=8):
    good, n, s, scatter = plain(rows)
    got = {}
    for r in df.collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    dims = len(s)
    k = min(components, dims)
    assert sorted(got) == sorted(i for i, _ in good) and all(sorted(v) == list(range(1, k + 1)) for v in got.values())
    cov = np.array([[v / n**2 for v in row] for row in scatter])
    values, vectors = np.linalg.eigh(cov)
    white = []
    for i, x in good:
        assert {r["n"] for r in got[i].values()} == {n}
        assert {int(r["deviation"]) for r in got[i].values()} == {sum((n * a - b) ** 2 for a, b in zip(x, s))}
        centred = np.array([(n * a - b) / n for a, b in zip(x, s)])
        white.append([got[i][c]["whitened"] for c in range(1, k + 1)])
        for c in range(1, k + 1):
            e, u = values[-c], vectors[:, -c]
            assert abs(abs(got[i][c]["whitened"]) - abs(centred @ u / math.sqrt(e))) < 1e-6
            assert abs(got[i][c]["explained"] - e / (np.trace(cov))) <= 1e-9
    white = np.array(white)
    measured = np.abs(white.T @ white / n - white.mean(0)[:, None] * white.mean(0)[None, :] - np.eye(k)).max()
    errors = {r["identity_error"] for v in got.values() for r in v.values()}
    assert len(errors) == 1 and measured < 1e-6 and errors.pop() < 1e-6


def test_query_by_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    df = QUERIES["op13_embedding_whitening"](spark, SMALL)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
                               "whitened": "double", "explained": "double", "identity_error": "double"}
    check(df, rows)


@pytest.mark.parametrize("rows, dims, spread", [(1, 1, 10), (65, 3, 700), (5000, 4, 2**17), (130, 5, 2**40), (70, 2, 2**63)])
def test_cross_products_are_exact(rows, dims, spread):
    draw = np.random.default_rng(rows)
    y = draw.integers(0, spread, (rows, dims), np.uint64, endpoint=True)
    cross, sums = np.zeros((dims, dims), object), np.zeros(dims, object)
    planes = int(y.max()).bit_length() or 1
    for at in range(0, rows, 4096):
        c, s = whitening.cross_products(whitening.bit_planes(y[at:at + 4096], planes))
        cross, sums = cross + c, sums + s
    exact = y.astype(object)
    assert (np.triu(cross) == np.triu(exact.T @ exact)).all() and (sums == exact.sum(axis=0)).all()


def frame(spark, rows, kind="double", parts=3):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").repartition(parts)


def run(df, components=8):
    return whitening.whiten(df, whitening.fit(df, components=components))


def test_left_out_repeated_and_null_rows(spark):
    draw = np.random.default_rng(4)
    good = [(i, draw.normal(size=3).tolist()) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [math.nan, 1.0, 1.0]), (103, [math.inf, 0.0, 0.0]), (104, []),
           (105, [1.0, 2.0]), (106, [-math.inf, 0.0, 1.0]), (107, [1e300, 0.0, 0.0])]
    check(run(frame(spark, good + bad)), good)
    # a null or repeated id is a row like any other, and extra columns do no harm
    more = frame(spark, [*good, (None, [0.5, 0.5, 0.5]), good[0]]).withColumn("component", F.lit("own")).withColumn("n", F.lit(1))
    out = run(more).collect()
    assert len(out) == 42 * 3 and {r["n"] for r in out} == {42} and sum(r["vec_id"] is None for r in out) == 3


def test_wide_spans_negative_and_large_values(spark):
    draw = np.random.default_rng(5)
    rows = [(i, (draw.normal(size=4) * [1, 1e3, 1e3, 2e3] + [0, -5e4, 3e5, 0]).tolist()) for i in range(300)]
    check(run(frame(spark, rows)), rows)
    huge = [(i, (draw.normal(size=2) * 1e13).tolist()) for i in range(50)]
    check(run(frame(spark, huge)), huge)
    assert {r["deviation"] for r in run(frame(spark, [(0, [8e15]), (1, [-8e15]), *[(i, [0.0]) for i in range(2, 40)]])).collect()} > {None}


def test_one_vector_in_a_third_of_the_rows(spark):
    draw = np.random.default_rng(6)
    rows = [(i, [0.25, -0.5, 0.125, 1.0] if i % 3 == 0 else draw.normal(size=4).tolist()) for i in range(900)]
    check(run(frame(spark, rows, "float")), [(i, [float(np.float32(c)) for c in v]) for i, v in rows])


def test_components_without_variance(spark):
    flat = run(frame(spark, [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)])).collect()
    assert [r["component"] for r in flat if r["whitened"] is not None] == [1] * 9
    assert all(abs(r["explained"] - (r["component"] == 1)) < 1e-12 for r in flat)
    same = run(frame(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect()
    assert len(same) == 10 and all(r["whitened"] is r["explained"] is r["identity_error"] is None and r["deviation"] == 0 for r in same)
    assert run(frame(spark, [])).collect() == [] and run(frame(spark, [(1, None)])).collect() == []
    assert len(run(frame(spark, [(i, [float(i % 7), float(i % 5)]) for i in range(35)]), components=1).collect()) == 35
