"""Change-only upsert by key.

A staged row is inserted, or updates its target row only where they differ by
IS DISTINCT FROM; nothing is deleted, so running the same batch twice changes
nothing the second time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_distinct(left: str, right: str, columns) -> Column:
    """Null-safe row difference: NULL equals NULL and NaN equals NaN."""
    pairs = [~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns]
    return reduce(lambda a, b: a | b, pairs)


def null_safe_distinct(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, is_distinct) for the keys both sides hold."""
    columns = [c for c in left.columns if c != key]
    return (
        left.alias("l")
        .join(right.alias("r"), key)
        .select(F.col(key), is_distinct("l", "r", columns).alias("is_distinct"))
    )


def upsert_rows(target: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """The merged table with an `action` per row: insert, update, unchanged or keep.

    One full outer equi-join on the key. Both sides are keyed uniquely (the
    batch validation guarantees it), so no key can be hot. Where both sides are
    partitioned by the same bucket column, restrict both to the touched buckets
    first, as the snapshot writer does.
    """
    columns = [c for c in target.columns if c != key]
    marked_target = target.withColumn("_present", F.lit(True))
    marked_staged = staged.select(target.columns).withColumn("_present", F.lit(True))
    joined = marked_target.alias("t").join(
        marked_staged.alias("s"), F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer"
    )
    action = (
        F.when(F.col("s._present").isNull(), "keep")
        .when(F.col("t._present").isNull(), "insert")
        .when(is_distinct("t", "s", columns), "update")
        .otherwise("unchanged")
    )
    staged_wins = F.col("s._present").isNotNull()
    merged = [
        F.when(staged_wins, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in columns
    ]
    return joined.select(
        F.coalesce(f"t.{key}", f"s.{key}").alias(key), *merged, action.alias("action")
    )


def upsert_actions(target: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    return (
        upsert_rows(target, staged, key)
        .groupBy("action")
        .agg(F.count("*").alias("n_rows"))
        .orderBy("action")
    )
