"""The append-only prediction log: Parquet by log date, then batch.

A batch is one folder, log_date=D/batch_id=B, named by the day it was logged.
Its success marker commits it; folders without one are never read. A note by its
id, written before the rows, says which day that was, so an append looks at one
path and not at the log's dates. Readers name the dates they need.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwatch import schema as S
from millwatch.operators import quality
from millwatch.session import matching_paths, path_exists

CURRENT_COLUMNS = (*S.FEATURES, "risk_tier", "predicted_mode")
_PARTITIONS = [T.StructField("log_date", T.DateType()), T.StructField("batch_id", T.StringType())]
_DONE = "_SUCCESS"


def _note(root: str, batch_id: int | str) -> str:
    return f"{root}/_batches/batch_id={batch_id}"


def _dated(root: str, date: str, batch_id: int | str) -> str:
    return f"{root}/log_date={date}/batch_id={batch_id}"


def _named_date(spark: SparkSession, root: str, batch_id: int | str) -> str | None:
    """The date a batch was first begun on, from the note written before its rows: one path, however long the log is."""
    note = _note(root, batch_id)
    return spark.read.text(note).first()["value"] if path_exists(spark, f"{note}/{_DONE}") else None


def _folder(spark: SparkSession, root: str, batch_id: int | str) -> str | None:
    """Where a batch belongs if it was ever begun; of batches without a note, those of today and the day before."""
    date = _named_date(spark, root, batch_id)
    if date:
        return _dated(root, date, batch_id)
    today = datetime.datetime.now(datetime.timezone.utc).date()
    near = [_dated(root, (today - datetime.timedelta(days=d)).isoformat(), batch_id) for d in (0, 1)]
    return next((path for path in near if path_exists(spark, f"{path}/{_DONE}")), None)


def is_committed(spark: SparkSession, root: str, batch_id: int | str) -> bool:
    path = _folder(spark, root, batch_id)
    return path is not None and path_exists(spark, f"{path}/{_DONE}")


def _begin(spark: SparkSession, root: str, batch_id: int | str) -> str:
    """Note today as the batch's date, so that a replay on a later day finds its folder without a search."""
    today = datetime.datetime.now(datetime.timezone.utc).date().isoformat()
    spark.createDataFrame([(today,)], "value string").coalesce(1).write.mode("overwrite").text(_note(root, batch_id))
    return _dated(root, today, batch_id)


def append(records: DataFrame, root: str, batch_id: int | str) -> DataFrame:
    """Commit a batch of log rows and return them as committed, ids and times included.

    Every named constraint holds or the write fails and nothing is committed. Ids
    and times are drawn while writing, so the committed files are the only place
    to read them from; a batch that is already committed is not written again. A
    bloom filter on the id lets lookups skip row groups.
    """
    spark = records.sparkSession
    quality.require_columns(records, S.LOG_COLUMNS, "A log record")
    path = _folder(spark, root, batch_id) or _begin(spark, root, batch_id)
    if not path_exists(spark, f"{path}/{_DONE}"):
        stamped = quality.strict(
            records.select(*S.LOG_COLUMNS), quality.log_checks(), S.LOG_COLUMNS
        ).select(
            F.expr("uuid()").alias("request_id"),
            F.current_timestamp().alias("created_at"),
            *S.LOG_COLUMNS,
        )
        (
            stamped.write.mode("overwrite")
            .option("parquet.bloom.filter.enabled#request_id", "true")
            .parquet(path)
        )
    return spark.read.schema(S.LOG_SCHEMA).parquet(path)


def _first_date(since: datetime.datetime) -> datetime.date:
    """The first date that can hold rows of a window: a batch may cross midnight, in any zone."""
    return since.astimezone(datetime.timezone.utc).date() - datetime.timedelta(days=1)


def read_log(spark: SparkSession, root: str, since: datetime.datetime | None = None) -> DataFrame:
    """Committed rows, with the `log_date` and `batch_id` partition columns; with `since`, of the dates it needs.

    Spark is given one path per date and lists what is below them; only batches
    that never ended are named, to be left out.
    """
    dates = matching_paths(spark, f"{root}/log_date=*")
    if since is not None:
        require_aware(since)
        dates = [d for d in dates if d.rpartition("=")[2] >= _first_date(since).isoformat()]
    held, open_batches = [], []
    for date in dates:
        begun = set(matching_paths(spark, f"{date}/batch_id=*"))
        done = {p.removesuffix(f"/{_DONE}") for p in matching_paths(spark, f"{date}/batch_id=*/{_DONE}")}
        held += [date] if done else []
        open_batches += [p.rpartition("batch_id=")[2] for p in sorted(begun - done)] if done else []
    schema = T.StructType([*S.LOG_SCHEMA.fields, *_PARTITIONS])
    if not held:
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", root).schema(schema).parquet(*held)
    return rows.where(~F.col("batch_id").isin(open_batches)) if open_batches else rows


def require_aware(since: datetime.datetime) -> None:
    if since.tzinfo is None:
        raise ValueError(f"A window needs a timezone to begin at an instant; add one to {since}")


def since_rows(log: DataFrame, since: datetime.datetime) -> DataFrame:
    """Log rows at or after a cutoff: whole dates are pruned, then row groups.

    Dates are those of the session time zone; one day of slack covers any zone.
    """
    require_aware(since)
    rows = log.where(F.col("created_at") >= F.lit(since.astimezone(datetime.timezone.utc)))
    if "log_date" in log.columns:
        rows = rows.where(F.col("log_date") >= F.lit(_first_date(since)))
    return rows


def window_scan(log: DataFrame, since: datetime.datetime) -> DataFrame:
    """Inputs, tier and mode of every request since a cutoff."""
    return since_rows(log, since).select(*CURRENT_COLUMNS)


def reading_by_udi(readings: DataFrame, udi: int) -> DataFrame:
    return readings.where(F.col("udi") == udi)


def row_by_request(log: DataFrame, request_id: str) -> DataFrame:
    return log.where(F.col("request_id") == request_id)
