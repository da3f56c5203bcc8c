"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def skewable_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join whose left side AQE may split at a hot key.

    AQE only splits a hot partition when both sides come straight out of a shuffle. A side that
    was just aggregated by the key does not: Spark reuses its partitioning. A second key,
    derived from the first, asks for a fresh exchange of that (already reduced) side, and also
    keeps a later grouping by the key from pinning the layout. Nothing is replicated, and a
    small right side is still broadcast by AQE from its measured size.
    """
    bucket = F.pmod(F.xxhash64(*on), F.lit(1 << 20))
    return left.withColumn("_bucket", bucket).join(
        right.withColumn("_bucket", bucket), on=[*on, "_bucket"], how=how
    ).drop("_bucket")
