"""Workload per time window of a log stream that keeps its late rows.

`scoring.stream_workload` leaves windows to Spark's state, where rows behind the
watermark vanish with a mere count. Here each micro-batch writes its counts per
window, its late rows as they are, and the newest time seen so far, so that every
row sent is in a closed window, in an open one, or among the late rows. The
watermark of a batch is the newest time of the batches before it less the allowed
delay, as Spark's own is; a row is late if its window had ended by then. All three
are written under the batch's id and replaced if the batch is replayed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

COUNTS = ("n_rows", "n_elevated", "n_high", "n_flagged")


@dataclass(frozen=True)
class WorkloadPaths:
    root: str

    @property
    def counts(self) -> str:
        return f"{self.root}/counts"

    @property
    def late(self) -> str:
        return f"{self.root}/late"

    @property
    def marks(self) -> str:
        return f"{self.root}/marks"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"


def _stream_id(spark: SparkSession, paths: WorkloadPaths) -> str:
    return json.loads(spark.read.text(f"{paths.checkpoint}/metadata").first()["value"])["id"]


def _mark(spark: SparkSession, paths: WorkloadPaths, number: int) -> DataFrame:
    """(newest, number) after a batch: one row; before the first batch no time is known."""
    if number < 0:
        return spark.range(1).select(F.lit(None).cast("timestamp").alias("newest"), F.lit(-1).cast("long").alias("number"))
    path = f"{paths.marks}/stream={_stream_id(spark, paths)}/batch={number}"
    return spark.read.schema("newest timestamp, number long").parquet(path)


def _ended(window: Column, newest: Column, delay: str) -> Column:
    """Whether the watermark has passed the end of a window; never before a first time is known."""
    return F.coalesce(window.end <= newest - F.expr(f"INTERVAL {delay}"), F.lit(False))


def count_batch(batch: DataFrame, number: int, paths: WorkloadPaths, window: str, delay: str) -> None:
    """Deal one micro-batch to its windows and to the late rows.

    Rows without a time belong to no window and are kept with the late rows. The
    mark is written last, so a batch that has one has everything.
    """
    spark = batch.sparkSession
    place = f"stream={_stream_id(spark, paths)}/batch={number}"
    before = _mark(spark, paths, number - 1)
    newest = before.select("newest").scalar()
    batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        timed = batch.withColumn("window", F.window("created_at", window))
        late = F.coalesce(_ended(F.col("window"), newest, delay), F.lit(False))
        untimed = batch.where(F.col("created_at").isNull())
        behind = timed.where(late).drop("window").unionByName(untimed)
        behind.write.mode("overwrite").parquet(f"{paths.late}/{place}")
        tier = F.col("risk_tier")
        counts = timed.where(~late).groupBy("window").agg(
            F.count("*").alias("n_rows"),
            F.count_if(tier == "elevated").alias("n_elevated"),
            F.count_if(tier == "high").alias("n_high"),
            F.count_if(tier != "low").alias("n_flagged"),
        )
        counts.select("window.start", "window.end", *COUNTS).write.mode("overwrite").parquet(f"{paths.counts}/{place}")
        seen = batch.agg(F.max("created_at").alias("newest")).select(
            F.greatest("newest", newest).alias("newest"), F.lit(number).cast("long").alias("number")
        )
        seen.write.mode("overwrite").parquet(f"{paths.marks}/{place}")
    finally:
        batch.unpersist()


def start(log: DataFrame, paths: WorkloadPaths, window: str = "1 day", delay: str = "1 hour") -> StreamingQuery:
    """Count what has arrived since the last run and stop."""

    def handle(batch: DataFrame, number: int) -> None:
        count_batch(batch, number, paths, window, delay)

    writer = log.writeStream.foreachBatch(handle).option("checkpointLocation", paths.checkpoint)
    return writer.trigger(availableNow=True).start()


def read_windows(spark: SparkSession, paths: WorkloadPaths, delay: str = "1 hour") -> DataFrame:
    """One row per window with its counts and whether later rows may still join it.

    Sums the small counts of all batches. A batch in progress may already have
    its counts but no mark, so only batches up to the newest mark are summed.
    """
    marks = spark.read.schema("newest timestamp, number long, stream string").parquet(paths.marks)
    marks = marks.where(F.col("stream") == _stream_id(spark, paths))
    last = marks.agg(F.max("number")).scalar()
    newest = marks.agg(F.max("newest")).scalar()
    fields = ", ".join(["start timestamp", "end timestamp", *[f"{c} long" for c in COUNTS], "stream string, batch long"])
    counts = spark.read.schema(fields).parquet(paths.counts)
    counts = counts.where((F.col("stream") == _stream_id(spark, paths)) & (F.col("batch") <= last))
    summed = counts.groupBy(F.struct("start", "end").alias("window")).agg(*[F.sum(c).alias(c) for c in COUNTS])
    return summed.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *COUNTS,
        (F.col("n_flagged") / F.col("n_rows")).alias("share_flagged"),
        (~_ended(F.col("window"), newest, delay)).alias("is_open"),
    )


def read_late(spark: SparkSession, paths: WorkloadPaths, schema) -> DataFrame:
    """The late rows of finished batches, with the `batch` that brought them."""
    rows = spark.read.schema(schema).option("basePath", paths.late)
    rows = rows.parquet(f"{paths.late}/stream={_stream_id(spark, paths)}").drop("stream")
    marks = spark.read.schema("number long, stream string").parquet(paths.marks)
    last = marks.where(F.col("stream") == _stream_id(spark, paths)).agg(F.max("number")).scalar()
    return rows.where(F.col("batch") <= last)
