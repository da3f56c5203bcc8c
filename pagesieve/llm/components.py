"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from pagesieve.operators.skew import skewable_join
from pagesieve.session import materialize


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """Write a round to the shared folder; count and a sum of hashes tell whether it changed."""
    seen = Observation()
    sign = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    stored = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), sign.alias("sign")), "edges")
    return stored, (seen.get["n"], seen.get["sign"])


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step: the neighbours of a node are linked to the smallest of them. The minimum is
    an aggregate that shrinks before its shuffle; a node with very many neighbours is a hot key
    of the join only, which AQE splits."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = skewable_join(both, low, ["u"], "inner")
    if small:  # u > v throughout: v and u itself are linked to the minimum
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
    else:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter(F.col("u") > F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of any comparable type to (node, root), root the smallest node reachable.

    Only nodes with an edge to another node are returned. Self loops, repeated edges, null ends
    and an empty table are allowed. Every round is written to the shared folder, so a lost
    executor costs at most the running round, and no link ever reaches the driver.
    """
    linked = edges.filter(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state, sign = _stored(linked)
    while sign[0]:
        state, new = _stored(_star(_star(state, small=False), small=True))
        if new == sign:
            break
        sign = new
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
