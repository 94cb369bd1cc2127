"""Joins that keep working when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPREAD = "__spread"


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join to a table that has at most one row per key.

    Adaptive execution splits the partition of a hot key over several tasks, but only where
    both sides reach the join as plain shuffles; a side still partitioned by the aggregate
    that made it would rule that out. A hash of the key among the join keys asks for a
    partitioning of the join's own. Small tables are broadcast as ever, by their size.
    """
    left, right = (side.withColumn(SPREAD, F.xxhash64(*keys)) for side in (left, right))
    return left.join(right, [SPREAD, *keys], how).drop(SPREAD)
