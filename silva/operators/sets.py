"""Groups as lists and distinct rows in the order of their first occurrence, without a task that meets all rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import numbered


def distinct_in_order(df: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """The distinct ``keys``, each with ``name``, its place from 0 by the first row (by ``order``) that holds it. Null is a value; equal first rows go by the keys."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_least"))
    return numbered(first, ["_least", *keys], name).drop("_least")


def lists(df: DataFrame, keys: list[str], value: str, size: int = 10_000) -> DataFrame:
    """``keys``, part and ``value``: the group's values in ascending order, in lists of at most ``size``; ``part`` ascends with them.

    Rows are numbered in the order of keys and value, and every ``size`` numbers end a list, so a key with a third of all rows is many lists in many tasks. Null values
    are left out, and keys without any other value with them.
    """
    tie = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(4096))  # spreads rows that are equal over ranges
    own = df.select(*keys, value).where(F.col(value).isNotNull()).withColumn("_tie", tie)
    placed = numbered(own, [*keys, value, "_tie"], "_at")
    return placed.groupBy(*keys, F.floor(F.col("_at") / size).alias("part")).agg(F.sort_array(F.collect_list(value)).alias(value))
