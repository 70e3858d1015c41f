"""Score JSON readings as they arrive: validate, score, log, and only then publish.

Each micro-batch commits its log rows before it publishes recommendations, and
publishes from the committed rows, so nobody sees a recommendation that the log
does not hold. A batch that is replayed after a crash finds its log rows and
publishes the same ids again. Readings that fail validation go to a quarantine
with all their errors; they are neither scored nor logged. A log row that breaks
a constraint is a bug and fails the batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millwatch.operators import projections, quality, risk
from millwatch.sources import prediction_log


@dataclass(frozen=True)
class Served:
    """What scores the readings. `scorer` adds `proba` to the nine inputs."""

    scorer: Callable[[DataFrame], DataFrame]
    threshold: float
    name: str
    version: int


@dataclass(frozen=True)
class StreamPaths:
    root: str

    @property
    def log(self) -> str:
        return f"{self.root}/log"

    @property
    def published(self) -> str:
        return f"{self.root}/published"

    @property
    def quarantine(self) -> str:
        return f"{self.root}/quarantine"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"


def read_requests(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """One JSON reading per line, as text, so that validation sees what was sent."""
    return (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
        .withColumnRenamed("value", "body")
    )


def read_keyed_requests(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """One JSON envelope per line: `request_key`, `sent_at` and the reading as text in `body`."""
    envelope = "request_key string, sent_at timestamp, body string"
    reader = spark.readStream.schema(envelope).option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def scored_once(requests: DataFrame, repeats_within: str = "1 day") -> DataFrame:
    """Keyed requests without those sent again, in the same batch, a later one or after a restart.

    The state holds one key per request until event time is `repeats_within` past
    it, the bound on a client's retries. A request that comes later than that
    behind the newest one can't be told from a retry and is dropped with them. One
    without a key or a time is never taken for a retry.
    """
    keyed = F.col("request_key").isNotNull() & F.col("sent_at").isNotNull()
    first = requests.where(keyed).withWatermark("sent_at", repeats_within).dropDuplicatesWithinWatermark(["request_key"])
    return first.unionByName(requests.where(~keyed))


def score_requests(accepted: DataFrame, served: Served) -> DataFrame:
    """Valid readings as log records; the same code serves batches."""
    inputs = projections.model_input(accepted)
    return risk.log_rows(served.scorer(inputs), served.threshold, served.name, served.version)


def stream_id(spark: SparkSession, paths: StreamPaths) -> str:
    """The id Spark keeps in the checkpoint. A stream that starts over without its
    checkpoint counts its batches from 0 again, but under another id."""
    return json.loads(spark.read.text(f"{paths.checkpoint}/metadata").first()["value"])["id"]


def process_batch(batch: DataFrame, batch_id: str, served: Served, paths: StreamPaths) -> None:
    """One micro-batch; `batch_id` names it for good, across restarts."""
    checked = quality.validate_readings(batch.select("body")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        accepted, rejected = quality.quarantine(checked)
        rejected.select("body", "violations").write.mode("overwrite").parquet(
            f"{paths.quarantine}/batch_id={batch_id}"
        )
        committed = prediction_log.append(score_requests(accepted, served), paths.log, batch_id)
        risk.recommendations(committed).write.mode("overwrite").parquet(
            f"{paths.published}/batch_id={batch_id}"
        )
    finally:
        checked.unpersist()


def start(requests: DataFrame, served: Served, paths: StreamPaths, once: bool = True) -> StreamingQuery:
    """Start scoring; `once` drains what is there and stops."""

    def handle(batch: DataFrame, number: int) -> None:
        name = f"{stream_id(batch.sparkSession, paths)}-{number}"
        process_batch(batch, name, served, paths)

    writer = requests.writeStream.foreachBatch(handle).option(
        "checkpointLocation", paths.checkpoint
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_workload(log: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Tier counts and flagged share per tumbling window of a stream of log rows.

    State is one row per open window; the watermark closes and drops windows.
    """
    n = F.count("*")
    flagged = F.count_if(F.col("risk_tier") != "low")
    return (
        log.withWatermark("created_at", delay)
        .groupBy(F.window("created_at", window))
        .agg(
            n.alias("n_rows"),
            F.count_if(F.col("risk_tier") == "elevated").alias("n_elevated"),
            F.count_if(F.col("risk_tier") == "high").alias("n_high"),
            (flagged / n).alias("share_flagged"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "n_rows", "n_elevated", "n_high", "share_flagged",
        )
    )
