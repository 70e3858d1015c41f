"""Sensor tables derived from the given `events` table.

Every event becomes one reading through seeded draws, scored readings get fixed
probabilities, and the log is the scored readings with their tiers. The tables
are written once per source folder to the shared folder and read from there, as
a user would query tables that were loaded before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch import schema as S
from millwatch.functions import classes, physics
from millwatch.functions.hashing import unit_draw
from millwatch.operators import projections, risk
from millwatch.session import path_exists, scratch_path

MODEL_NAME = "failure-classifier"
MODEL_VERSION = 1
LOG_THRESHOLD = 0.15

_written: dict[tuple[str, str, str], str] = {}


def _u(salt: str) -> Column:
    return unit_draw(salt, "udi")


def _centred(salt: str) -> Column:
    return _u(f"{salt}1") + _u(f"{salt}2") + _u(f"{salt}3") - F.lit(1.5)


def derive_readings(events: DataFrame) -> DataFrame:
    """`sensor_readings` plus `created_at`, row by row from `events`."""
    draws = events.select(
        F.col("event_id").alias("udi"), F.col("ts").cast("timestamp").alias("created_at")
    ).select(
        "*",
        _centred("air").alias("za"),
        _centred("pr").alias("zp"),
        _centred("rpm").alias("zr"),
        _centred("tq").alias("zt"),
        _u("type").alias("ut"),
        _u("wear").alias("uw"),
        _u("twf").alias("utwf"),
        _u("rnf").alias("urnf"),
        _u("unx").alias("uunx"),
    )
    grade = F.when(F.col("ut") < 0.6, "L").when(F.col("ut") < 0.9, "M").otherwise("H")
    za, zp, zr, zt = (F.col(c) for c in ("za", "zp", "zr", "zt"))
    measured = draws.select(
        "udi",
        "created_at",
        grade.alias("type"),
        (F.floor((300 + 4 * za) * 10) / 10).alias("air_temp_k"),
        (F.floor((310 + 4 * za + 2 * zp) * 10) / 10).alias("process_temp_k"),
        F.floor(1540 + 360 * zr).cast("int").alias("rotational_speed_rpm"),
        (F.floor(F.greatest(F.lit(0.0), 40 + 20 * zt) * 10) / 10).alias("torque_nm"),
        F.floor(F.col("uw") * 254).cast("int").alias("tool_wear_min"),
        "utwf",
        "urnf",
        "uunx",
    )
    ruled = measured.select("*", *physics.physics_columns()).select(
        "*",
        (physics.in_wear_window() & (F.col("utwf") < 0.05)).alias("twf"),
        physics.heat_rule().alias("hdf"),
        physics.power_rule().alias("pwf"),
        physics.strain_rule().alias("osf"),
        (F.col("urnf") < 0.002).alias("rnf"),
    )
    failed = F.col("twf") | F.col("hdf") | F.col("pwf") | F.col("osf") | (F.col("uunx") < 0.001)
    product = F.concat("type", F.lpad((F.col("udi") % 100000).cast("string"), 5, "0"))
    columns = {f: F.col(f) for f in S.READINGS_SCHEMA.names}
    columns |= {"product_id": product, "machine_failure": failed}
    return ruled.select(*[expr.alias(n) for n, expr in columns.items()], "created_at")


def derive_scored(readings: DataFrame) -> DataFrame:
    """Labelled rows with fixed probabilities: inputs, label, code `y`, `proba`."""
    labelled = projections.feature_view(readings).where(F.col("failure_type").isNotNull())
    weights = [
        F.when(F.col("failure_type") == S.NO_FAILURE, 0.55 + _u("w0")).otherwise(0.04 * _u("w0")),
        F.when(physics.in_wear_window(), 0.35 * _u("w1")).otherwise(0.01 * _u("w1")),
        F.when(
            (F.col("temp_diff_k") < 8.7) & (F.col("rotational_speed_rpm") < 1390),
            0.5 + 0.5 * _u("w2"),
        ).otherwise(0.01 * _u("w2")),
        F.when(
            (F.col("power_w") < 3550) | (F.col("power_w") > 8950), 0.5 + 0.5 * _u("w3")
        ).otherwise(0.01 * _u("w3")),
        F.when(F.col("strain_min_nm") > 11500, 0.3 + 0.5 * _u("w4")).otherwise(0.01 * _u("w4")),
    ]
    total = sum((F.col(f"w{k}") for k in range(1, 5)), F.col("w0"))
    weighted = labelled.select(
        "udi", "created_at", *S.FEATURES, "failure_type",
        *[w.alias(f"w{k}") for k, w in enumerate(weights)],
    ).withColumn("total", total)
    return weighted.select(
        "udi", "created_at", *S.FEATURES, "failure_type",
        classes.class_code("failure_type").alias("y"),
        F.array(*[F.col(f"w{k}") / F.col("total") for k in range(5)]).alias("proba"),
    )


def derive_log(scored: DataFrame) -> DataFrame:
    """`predictions_log` rows in log order, plus `udi` and `log_date`."""
    rows = risk.log_rows(
        scored.drop("failure_type", "y"), LOG_THRESHOLD, MODEL_NAME, MODEL_VERSION
    )
    request_id = F.md5(F.concat(F.lit("req:"), F.col("udi").cast("string")))
    return rows.withColumn("request_id", request_id).select(
        "udi", *S.LOG_SCHEMA.names, F.to_date("created_at").alias("log_date")
    )


def _spread(df: DataFrame) -> DataFrame:
    """Use every core even where the source is one small file."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _table(spark: SparkSession, sf_dir: str, name: str, build, partition_by=()) -> DataFrame:
    """Write a derived table on first use in this session; read it afterwards."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    path = _written.get(key)
    if path is None or not path_exists(spark, f"{path}/_SUCCESS"):
        path = scratch_path(spark, f"inputs-{name}")
        build().write.partitionBy(*partition_by).parquet(path)
        _written[key] = path
    return spark.read.parquet(path)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def readings_with_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        return derive_readings(_spread(events(spark, sf_dir).select("event_id", "ts")))

    return _table(spark, sf_dir, "readings", build)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_with_time(spark, sf_dir).drop("created_at")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.feature_view(readings(spark, sf_dir))


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.training_rows(readings(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(
        spark, sf_dir, "scored", lambda: derive_scored(readings_with_time(spark, sf_dir))
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(
        spark, sf_dir, "log", lambda: derive_log(scored(spark, sf_dir)), ("log_date",)
    )


def tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.assign_tiers(scored(spark, sf_dir), LOG_THRESHOLD)


def reference_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference side of the drift checks: the readings outside the current window."""
    rows = readings(spark, sf_dir).where(F.col("udi") % 5 != 0)
    return projections.model_input(rows, "udi")


def current_window(spark: SparkSession, sf_dir: str, fault_k: float = 0.0) -> DataFrame:
    """Current side: every fifth reading, optionally with the air sensor reading high."""
    rows = readings(spark, sf_dir).where(F.col("udi") % 5 == 0)
    if fault_k:
        rows = rows.withColumn("air_temp_k", F.col("air_temp_k") + fault_k)
    return projections.model_input(rows, "udi")
