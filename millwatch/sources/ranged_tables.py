"""A keyed table on Spark's own layout: partitions by key range, buckets by key.

The table is a Parquet table of the session catalog, partitioned by ranges of its
whole-number key, bucketed and sorted by the key. An upsert reads the ranges that
its batch names, joins them bucket by bucket, so that only the batch is
exchanged, and overwrites the ranges in which a row changed. New readings have
adjacent keys and meet few ranges; how many were read and written is reported.

A bucket is one task for all ranges of a join. A batch that meets so many rows
that a bucket of them is too much for a task has both sides dealt to more tasks
by range and bucket: the ranges it meets are exchanged too, and a bucket of a
range is still written by one task, as one file.

Spark writes the new files of a range beside the table and swaps them in at the
end of the job. A job that dies while writing leaves the table as it was; a
driver lost in the midst of the swap leaves the files that were not yet moved
below `.spark-staging-*`, and the batch has to be run again once they are moved.
One writer at a time; a reader that started before a swap has to start again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwatch import schema as S
from millwatch.operators import quality, upsert
from millwatch.session import materialise, path_exists

RANGE = "key_range"
WIDTH = "millwatch.range_width"
KEYS_PER_RANGE = 50_000_000
BUCKETS = 64
# How many rows of a side one task of a join should hold.
TASK_ROWS = 500_000
_TASK = "_join_task"


@dataclass(frozen=True)
class Upserted:
    """Rows of the batch by action, and the part of the table that it took."""

    insert: int
    update: int
    unchanged: int
    ranges_read: int
    ranges_written: int


def open_table(
    spark: SparkSession,
    name: str,
    path: str,
    key: str = "udi",
    schema: T.StructType = S.READINGS_SCHEMA,
    width: int = KEYS_PER_RANGE,
    buckets: int = BUCKETS,
) -> None:
    """Name the table at `path` in the session catalog; an empty folder is a new table.

    A range of `width` keys is the unit of rewriting, a bucket of a range one file
    and, in a join, the least that a task can hold. Both must be given as they were when the table was
    made: a catalog that outlives the session keeps them and refuses others.
    """
    if schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{key} must be a whole number to be cut into ranges, not {schema[key].dataType.simpleString()}")
    if taken := {RANGE, _TASK} & set(schema.names):
        raise ValueError(f"{taken.pop()} names the place of a row; rename that column of the rows")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}, {RANGE} bigint) USING parquet "
        f"OPTIONS (partitionOverwriteMode 'dynamic') PARTITIONED BY ({RANGE}) "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS "
        f"LOCATION '{path}' TBLPROPERTIES ('{WIDTH}' = '{width}')"
    )
    held = _layout(spark, name)
    if held != (key, width, buckets):
        raise ValueError(f"{name} has key, range width and buckets {held}, not {(key, width, buckets)}")
    if path_exists(spark, path):
        spark.catalog.recoverPartitions(name)


def _layout(spark: SparkSession, name: str) -> tuple[str, int, int]:
    """(key, width, buckets) as the catalog holds them."""
    facts = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    width = spark.sql(f"SHOW TBLPROPERTIES {name} ('{WIDTH}')").first()["value"]
    return facts["Bucket Columns"].strip("[]`"), int(width), int(facts["Num Buckets"])


def range_of(key: str, width: int) -> Column:
    """The range of a key; whole numbers below zero have ranges of their own."""
    wide = f"cast(`{key}` AS bigint)"
    return F.expr(f"({wide} - pmod({wide}, {width}L)) div {width}L")


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name).drop(RANGE)


def read_keys(spark: SparkSession, name: str, keys: list[int]) -> DataFrame:
    """The rows of a few keys: only their ranges and buckets are opened."""
    key, width, _ = _layout(spark, name)
    ranges = sorted({k // width for k in keys})
    return spark.table(name).where(F.col(RANGE).isin(ranges) & F.col(key).isin(keys)).drop(RANGE)


def tasks_for(rows: int, buckets: int) -> int | None:
    """Into how many tasks a join of so many rows is dealt; None where the buckets do."""
    tasks = -(-rows // TASK_ROWS)
    return tasks if tasks > buckets else None


def _dealt(rows: DataFrame, key: str, buckets: int, tasks: int) -> DataFrame:
    """Rows by range and bucket; the hash is that of the files, so that a file has one writer."""
    bucket = F.pmod(F.hash(key), F.lit(buckets))
    place = F.pmod(F.xxhash64(RANGE, bucket), F.lit(tasks)).cast("int")
    return rows.withColumn(_TASK, place).repartitionById(tasks, _TASK)


def _sides(
    target: DataFrame, staged: DataFrame, key: str, buckets: int, tasks: int | None
) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides as `t` and `s`, dealt if there are `tasks`, and the condition that joins them."""
    keys = [key]
    if tasks:
        target, staged = (_dealt(side, key, buckets, tasks) for side in (target, staged))
        keys = [_TASK, key]
    same = reduce(lambda a, b: a & b, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys])
    return target.alias("t"), staged.alias("s"), same


def marked_batch(
    target: DataFrame, staged: DataFrame, key: str, buckets: int = BUCKETS, tasks: int | None = None
) -> DataFrame:
    """Rows of the batch with their `action`; without `tasks` the target side is read bucket by bucket."""
    columns = [c for c in staged.columns if c not in (key, RANGE)]
    held, sent, same = _sides(target.withColumn("_present", F.lit(True)), staged, key, buckets, tasks)
    action = (
        F.when(F.col("t._present").isNull(), "insert")
        .when(upsert.is_distinct("t", "s", columns), "update")
        .otherwise("unchanged")
    )
    joined = sent.join(held, same, "left")
    return joined.select(*[F.col(f"s.{c}") for c in staged.columns], action.alias("action"))


def merged_rows(
    target: DataFrame, changes: DataFrame, key: str, buckets: int = BUCKETS, tasks: int | None = None
) -> DataFrame:
    """The target with changed rows in place of its own, dealt as in `marked_batch`.

    One full outer join on the key, which both sides hold once.
    """
    new = changes.select(*target.columns).withColumn("_new", F.lit(True))
    held, sent, same = _sides(target, new, key, buckets, tasks)
    joined = held.join(sent, same, "full_outer")
    taken = [F.when(F.col("s._new"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in target.columns]
    return joined.select(*taken)


def upsert_table(batch: DataFrame, name: str, proven_unique: bool = False) -> Upserted:
    """Upsert a batch into an opened table.

    What is kept between the two joins are the marked rows of the batch, never
    rows of the table. The driver gets one row per range and action. Null keys
    are refused, and so are repeated ones unless validation has ruled them out.
    """
    spark = batch.sparkSession
    key, width, buckets = _layout(spark, name)
    table = spark.table(name)
    names = [c for c in table.columns if c != RANGE]
    staged = batch.select(*names)
    if not proven_unique:
        quality.require_unique(staged, key)
    readings = names == S.READINGS_SCHEMA.names
    checks, wanted = (quality.table_checks(), names) if readings else ({}, [key])
    staged = quality.strict(staged, checks, wanted, guard=key).withColumn(RANGE, range_of(key, width))
    staged = materialise(staged.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema]))

    sent = {r[RANGE]: r["n"] for r in staged.groupBy(RANGE).agg(F.count("*").alias("n")).collect()}
    touched = list(sent)
    partitions = {r["partition"] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()}
    held = [r for r in touched if f"{RANGE}={r}" in partitions]
    met = table.where(F.col(RANGE).isin(touched))
    n_held = len(held) * width  # at most; counted, which opens the files, only where that is too much for a bucket
    if tasks_for(n_held, buckets):
        n_held = met.count()
    tasks = tasks_for(max(n_held, sum(sent.values())), buckets)
    marked = materialise(marked_batch(met, staged, key, buckets, tasks))
    counts = marked.groupBy(RANGE, "action").agg(F.count("*").alias("n")).collect()
    totals = {action: sum(r["n"] for r in counts if r["action"] == action) for action in ("insert", "update", "unchanged")}
    changed = sorted({r[RANGE] for r in counts if r["action"] != "unchanged"})
    if changed:
        kept = table.where(F.col(RANGE).isin(changed))
        changes = marked.where(F.col("action") != "unchanged")
        n_kept = min(n_held, len(set(changed) & set(held)) * width)
        tasks = tasks_for(n_kept + totals["insert"], buckets)
        merged_rows(kept, changes, key, buckets, tasks).write.mode("overwrite").insertInto(name)
    return Upserted(**totals, ranges_read=len(held), ranges_written=len(changed))
