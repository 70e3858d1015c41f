"""Feature view, model input and label encoding: narrow projections, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch import schema as S
from millwatch.functions import classes, physics


def feature_view(readings: DataFrame) -> DataFrame:
    """Readings with the physics features and the failure label."""
    return readings.select(
        "*", *physics.physics_columns(), physics.failure_label().alias("failure_type")
    )


def add_physics(readings: DataFrame) -> DataFrame:
    """Add the physics features; every missing raw input is named in one error."""
    missing = [c for c in S.RAW_INPUTS if c not in readings.columns]
    if missing:
        raise ValueError(f"Physics features need all of {list(S.RAW_INPUTS)}; add {missing} to the readings")
    kept = [c for c in readings.columns if c not in S.PHYSICS]
    return readings.select(*kept, *physics.physics_columns())


def model_input(readings: DataFrame, *keep: str) -> DataFrame:
    """Exactly the nine inputs in model order, after any `keep` columns."""
    return add_physics(readings).select(*keep, *S.FEATURES)


def training_rows(readings: DataFrame, id_column: str = "udi") -> DataFrame:
    """Labelled rows only: nine inputs, label and id. Row order carries no meaning."""
    return (
        feature_view(readings)
        .where(F.col("failure_type").isNotNull())
        .select(id_column, *S.FEATURES, "failure_type")
    )


def encode_labels(df: DataFrame, label: str = "failure_type", out: str = "y") -> DataFrame:
    return df.withColumn(out, classes.class_code(label))


def decode_labels(df: DataFrame, code: str = "y", out: str = "label") -> DataFrame:
    return df.withColumn(out, classes.class_name(code))


def encode_grade(df: DataFrame, grade: str = "type", out: str = "type_code") -> DataFrame:
    return df.withColumn(out, classes.grade_code(grade))


def physics_rules(features: DataFrame, id_column: str = "udi") -> DataFrame:
    return features.select(
        id_column,
        physics.heat_rule().alias("hdf_rule"),
        physics.power_rule().alias("pwf_rule"),
        physics.strain_rule().alias("osf_rule"),
    )


def wear_window(readings: DataFrame) -> DataFrame:
    return readings.where(physics.in_wear_window())


def healthy_and_flagged(tiers: DataFrame, id_column: str = "udi") -> DataFrame:
    return tiers.select(
        id_column,
        classes.healthy("y").alias("is_healthy"),
        classes.flagged("risk_tier").alias("is_flagged"),
    )
