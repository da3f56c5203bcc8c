"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it in `body`. Lambdas are interpreted, so an
    expression repeated inside one would otherwise be computed again for each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
