"""Label audits and exploratory aggregates.

Each audit is one scan with partial aggregation and a result of a few rows; the
ORDER BY only sorts that result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwatch import schema as S
from millwatch.functions import physics
from millwatch.session import dimension


def label_audit_modes(readings: DataFrame) -> DataFrame:
    return (
        readings.groupBy("machine_failure", physics.mode_count().alias("n_modes"))
        .agg(F.count("*").alias("n_rows"))
        .orderBy("machine_failure", "n_modes")
    )


def label_audit_multi(readings: DataFrame) -> DataFrame:
    return (
        readings.where(physics.mode_count() > 1)
        .groupBy(*S.MODE_FLAGS)
        .agg(F.count("*").alias("n_rows"))
        .orderBy(F.desc("n_rows"), *S.MODE_FLAGS)
    )


def label_audit_contradictions(readings: DataFrame) -> DataFrame:
    return readings.agg(
        *[
            F.count_if(F.col(flag) & ~F.col("machine_failure")).alias(f"{flag}_without_failure")
            for flag in S.MODE_FLAGS
        ]
    )


def label_counts(features: DataFrame, label: str = "failure_type") -> DataFrame:
    return (
        features.groupBy(label)
        .agg(F.count("*").alias("n_rows"))
        .orderBy(F.desc("n_rows"), F.asc_nulls_last(label))
    )


def spot_check(features: DataFrame, udi: int) -> DataFrame:
    """One row of the feature view, rounded for reading; the key filter reaches the scan."""
    return features.where(F.col("udi") == udi).select(
        "udi",
        "rotational_speed_rpm",
        "torque_nm",
        "air_temp_k",
        "process_temp_k",
        "tool_wear_min",
        F.round("power_w", 1).alias("power_w"),
        F.round("temp_diff_k", 2).alias("temp_diff_k"),
        F.round("strain_min_nm", 1).alias("strain_min_nm"),
    )


def rule_agreement(features: DataFrame) -> DataFrame:
    """Rule hits, flag hits and disagreements per mode, all in one scan."""
    rules: dict[str, Column] = {
        "hdf": physics.heat_rule(),
        "pwf": physics.power_rule(),
        "osf": physics.strain_rule(),
    }
    counts = []
    for mode, rule in rules.items():
        counts += [
            F.count_if(rule).alias(f"{mode}_rule"),
            F.count_if(F.col(mode)).alias(f"{mode}_flag"),
            F.count_if(rule != F.col(mode)).alias(f"{mode}_disagree"),
        ]
    return features.agg(*counts)


def class_share(features: DataFrame, label: str = "failure_type") -> DataFrame:
    """Count and percentage per class; the window runs over one row per class."""
    total = F.sum("n_rows").over(Window.partitionBy())
    return (
        features.groupBy(label)
        .agg(F.count("*").alias("n_rows"))
        .withColumn("pct", F.round(F.lit(100.0) * F.col("n_rows") / total, 2))
        .orderBy(F.desc("n_rows"), F.asc_nulls_last(label))
    )


def class_profile(features: DataFrame, label: str = "failure_type") -> DataFrame:
    """Rounded averages of six inputs per class."""
    averages = [
        ("power_w", "avg_power_w", 1),
        ("temp_diff_k", "avg_temp_diff_k", 2),
        ("strain_min_nm", "avg_strain_min", 1),
        ("tool_wear_min", "avg_tool_wear_min", 0),
        ("rotational_speed_rpm", "avg_rotational_speed", 0),
        ("torque_nm", "avg_torque", 1),
    ]
    return (
        features.groupBy(label)
        .agg(*[F.round(F.avg(c), digits).alias(name) for c, name, digits in averages])
        .orderBy(F.asc_nulls_last(label))
    )


def wear_window_counts(features: DataFrame) -> DataFrame:
    return features.agg(
        F.count_if(physics.in_wear_window()).alias("in_window"),
        F.count_if(physics.in_wear_window() & F.col("twf")).alias("in_window_twf"),
    )


def type_by_class(features: DataFrame, label: str = "failure_type") -> DataFrame:
    """Grade by class; the unlabelled rows fall in no column."""
    return (
        features.groupBy("type")
        .agg(*[F.count_if(F.col(label) == name).alias(name.lower()) for name in S.CLASSES])
        .orderBy("type")
    )


def counts_per_member(df: DataFrame, column: str, members: Sequence[str]) -> DataFrame:
    """Row count of every listed member in list order; an absent one counts 0."""
    counted = df.groupBy(column).agg(F.count("*").alias("n"))
    listed = dimension(df.sparkSession, **{column: tuple(members)})
    return (
        listed.join(counted, column, "left")
        .select(f"{column}_pos", column, F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"))
        .orderBy(f"{column}_pos")
        .drop(f"{column}_pos")
    )


def tier_counts(log: DataFrame) -> DataFrame:
    return counts_per_member(log, "risk_tier", S.TIERS)


def mode_counts(log: DataFrame) -> DataFrame:
    return counts_per_member(log, "predicted_mode", S.CLASSES)


def tier_shares(log: DataFrame) -> DataFrame:
    """Share of each tier plus flagged = elevated + high; an empty window is an error."""
    counts = log.agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(F.col("risk_tier") == t).alias(t) for t in S.TIERS],
    )
    return shares_of(counts)


def shares_of(counts: DataFrame) -> DataFrame:
    """Shares from one row of tier counts."""
    undefined = F.raise_error(F.lit("Shares need a request at least; widen the window, which is empty"))
    total = sum((F.col(t) for t in S.TIERS[1:]), F.col(S.TIERS[0]))
    checked = F.when(total > 0, total).otherwise(undefined.cast("long"))
    shares = counts.select(*[(F.col(t) / checked).alias(f"share_{t}") for t in S.TIERS])
    return shares.withColumn("share_flagged", F.col("share_elevated") + F.col("share_high"))


def class_weights(df: DataFrame, label: str = "failure_type") -> DataFrame:
    """n / (k * n_c) per class present; the window runs over one row per class."""
    everything = Window.partitionBy()
    total = F.sum("n_rows").over(everything)
    present = F.count("*").over(everything)
    return (
        df.groupBy(label)
        .agg(F.count("*").alias("n_rows"))
        .withColumn("weight", total / (present * F.col("n_rows")))
    )


def sample_weights(df: DataFrame, label: str = "failure_type") -> DataFrame:
    """Every row with the weight of its class; one row per class is broadcast."""
    weights = class_weights(df, label).select(label, "weight")
    return df.join(F.broadcast(weights), label)
