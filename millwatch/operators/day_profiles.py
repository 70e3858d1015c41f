"""Drift of sliding windows from one small profile per log date.

A day's profile counts each value of each input, and each tier. Counts add up,
so a window is the sum of its days: a run over 30 days reads 30 profiles and no
log row, and a new day costs one pass over that day.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch import schema as S
from millwatch.operators import drift

TIER = "risk_tier"
PROFILE = "column string, value double, category string, n long, log_date date"
_CATEGORIES = (*S.CATEGORICAL_FEATURES, TIER)


def day_profiles(log: DataFrame) -> DataFrame:
    """(column, value, category, n, log_date) of log rows; null inputs have no value, null categories count."""
    none = F.lit(None)
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"), none.cast("string").alias("category")) for c in S.NUMERIC_FEATURES])
    categories = F.array(*[F.struct(F.lit(c).alias("column"), none.cast("double").alias("value"), F.col(c).cast("string").alias("category")) for c in _CATEGORIES])
    each = log.select("log_date", F.explode(F.concat(values, categories)).alias("x"))
    kept = F.col("x.column").isin(*_CATEGORIES) | F.col("x.value").isNotNull()
    return each.where(kept).groupBy("x.column", "x.value", "x.category", "log_date").agg(F.count("*").alias("n")).select(
        "column", "value", "category", "n", "log_date"
    )


def write_days(log: DataFrame, root: str) -> None:
    """Add or replace the profiles of the dates in `log`, each given whole; other dates stay."""
    days = day_profiles(log).repartition("log_date", "column")
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_date").parquet(root)


def read_days(spark: SparkSession, root: str, first: datetime.date, last: datetime.date) -> DataFrame:
    """Profiles of the dates from `first` to `last`, both included; others are not opened."""
    days = spark.read.schema(PROFILE).parquet(root)
    return days.where(F.col("log_date").between(F.lit(first), F.lit(last)))


def window_profile(days: DataFrame) -> DataFrame:
    """(column, value, category, n): the sum of its days."""
    return days.groupBy("column", "value", "category").agg(F.sum("n").alias("n"))


def window_verdicts(reference: DataFrame, days: DataFrame, threshold: float = S.DRIFT_THRESHOLD) -> DataFrame:
    """One verdict per input of a window given as days, against a stored reference profile."""
    window = window_profile(days)
    grade = F.col("column").isin(*S.CATEGORICAL_FEATURES)
    numeric = drift.wasserstein_between(reference.where(F.col("value").isNotNull()), window.where(F.col("value").isNotNull()))
    shares = drift.js_between(reference.where(grade), window.where(grade))
    return drift.column_verdicts(numeric.unionByName(shares), threshold)


def window_load(days: DataFrame) -> DataFrame:
    """One row: requests of the window and per tier, as `drift.window_counts` has them from rows."""
    tiers = days.where(F.col("column") == TIER)
    none = F.lit(0).cast("long")
    return tiers.agg(
        F.coalesce(F.sum("n"), none).alias("n_current"),
        *[F.coalesce(F.sum(F.when(F.col("category") == t, F.col("n"))), none).alias(t) for t in S.TIERS],
    )
