"""A keyed Parquet table that is upserted bucket by bucket.

Rows live under data/version=V/bucket=B, the bucket being a hash of the key. An
upsert reads and rewrites only the buckets its batch touches, under a new
version, and then publishes a manifest naming the version that holds each
bucket and the number of buckets, which stays until the table is re-bucketed. A
job that dies before the manifest leaves the table as it was, and a batch that
changes nothing writes nothing. Versions are never edited, so a reader keeps a
consistent table.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwatch import schema as S
from millwatch.operators import quality, upsert
from millwatch.session import path_exists

BUCKETS = 64
ROWS_PER_FILE = 5_000_000


@dataclass(frozen=True)
class Manifest:
    """The newest published state: bucket -> version, the number of buckets, the last version used."""

    versions: dict[int, int] = field(default_factory=dict)
    buckets: int = 0
    last: int = 0


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, root: str) -> Manifest:
    """At most one row per bucket."""
    path = f"{root}/manifest"
    if not path_exists(spark, path):
        return Manifest()
    entries = spark.read.schema("bucket int, version int, buckets int, generation int").parquet(path)
    newest = entries.agg(F.max("generation")).first()[0]
    rows = entries.where(F.col("generation") == newest).collect()
    return Manifest({r["bucket"]: r["version"] for r in rows}, rows[0]["buckets"], newest)


def _publish(spark: SparkSession, root: str, manifest: Manifest) -> None:
    rows = [(b, v, manifest.buckets) for b, v in sorted(manifest.versions.items())]
    entries = spark.createDataFrame(rows, "bucket int, version int, buckets int").coalesce(1)
    entries.write.mode("overwrite").parquet(f"{root}/manifest/generation={manifest.last}")


def _read(
    spark: SparkSession, root: str, schema: T.StructType, manifest: Manifest,
    only: Iterable[int] | None = None,
) -> DataFrame:
    held = manifest.versions
    wanted = sorted(held if only is None else set(only) & set(held))
    if not wanted:
        return spark.createDataFrame([], schema)
    paths = [f"{root}/data/version={held[b]}/bucket={b}" for b in wanted]
    return spark.read.schema(schema).parquet(*paths)


def _write(rows: DataFrame, root: str, schema: T.StructType, key: str, manifest: Manifest, largest: int) -> None:
    """Rows by bucket under the manifest's last version; a bucket of many rows is several tasks and files."""
    files = -(-largest // ROWS_PER_FILE)
    dealt = rows.select(*schema.names, _bucket(key, manifest.buckets).alias("bucket"))
    if files > 1:
        part = F.pmod(F.xxhash64(F.lit("file"), key), F.lit(files))
        dealt = dealt.repartition(files * manifest.buckets, "bucket", part)
    else:
        dealt = dealt.repartition("bucket")
    (
        dealt.write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(f"{root}/data/version={manifest.last}")
    )


def read_table(
    spark: SparkSession, root: str, schema: T.StructType = S.READINGS_SCHEMA
) -> DataFrame:
    return _read(spark, root, schema, _manifest(spark, root))


def read_key(
    spark: SparkSession, root: str, value, key: str = "udi", schema: T.StructType = S.READINGS_SCHEMA
) -> DataFrame:
    """The row of one key, from the one bucket that can hold it."""
    manifest = _manifest(spark, root)
    if not manifest.versions:
        return spark.createDataFrame([], schema)
    typed = spark.range(1).select(F.lit(value).cast(schema[key].dataType).alias(key))
    bucket = typed.select(_bucket(key, manifest.buckets)).first()[0]
    return _read(spark, root, schema, manifest, [bucket]).where(F.col(key) == F.lit(value))


def rebucket_table(
    spark: SparkSession, root: str, buckets: int, key: str = "udi",
    schema: T.StructType = S.READINGS_SCHEMA,
) -> None:
    """Deal the whole table to another number of buckets, published at once."""
    manifest = _manifest(spark, root)
    rows = _read(spark, root, schema, manifest)
    counts = rows.groupBy(_bucket(key, buckets).alias("bucket")).agg(F.count("*").alias("n")).collect()
    if not counts:
        return
    version = manifest.last + 1
    dealt = Manifest({r["bucket"]: version for r in counts}, buckets, version)
    _write(rows, root, schema, key, dealt, max(r["n"] for r in counts))
    _publish(spark, root, dealt)


def upsert_table(
    batch: DataFrame,
    root: str,
    key: str = "udi",
    schema: T.StructType = S.READINGS_SCHEMA,
    buckets: int | None = None,
    proven_unique: bool = False,
) -> dict[str, int]:
    """Upsert a batch; returns the rows per action (insert, update, unchanged).

    `buckets` counts for a new table, `BUCKETS` by default; an existing one keeps
    its own, and another number is refused. A key that occurs twice has no single
    new value, and would be joined pair by pair: unless validation has ruled that
    out, it is looked for first and refused. Rows of the readings schema must
    keep the table's constraints, or the upsert fails by their names.
    """
    spark = batch.sparkSession
    manifest = _manifest(spark, root)
    if manifest.buckets and buckets not in (None, manifest.buckets):
        raise ValueError(
            f"The table has {manifest.buckets} buckets, not {buckets}; leave the number out or call rebucket_table"
        )
    if not proven_unique:
        quality.require_unique(batch, key)
    buckets = manifest.buckets or buckets or BUCKETS
    staged = batch.select(*schema.names)
    if schema is S.READINGS_SCHEMA:
        staged = quality.strict(staged, quality.table_checks(), schema.names, guard=key)
    # Bounded by the number of buckets, whatever the size of the batch.
    touched = [
        r["bucket"] for r in batch.select(_bucket(key, buckets).alias("bucket")).distinct().collect()
    ]
    target = _read(spark, root, schema, manifest, touched)
    merged = upsert.upsert_rows(target, staged, key).withColumn("bucket", _bucket(key, buckets))
    # One join: counted first, then its changed buckets are written from the same rows.
    merged.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        actions = merged.groupBy("bucket", "action").agg(F.count("*").alias("n")).collect()
        totals = {"insert": 0, "update": 0, "unchanged": 0}
        changed: dict[int, int] = {}
        for row in actions:
            if row["action"] in totals:
                totals[row["action"]] += row["n"]
            if row["action"] in ("insert", "update"):
                changed[row["bucket"]] = 0
        for row in actions:
            if row["bucket"] in changed:
                changed[row["bucket"]] += row["n"]
        if changed:
            version = manifest.last + 1
            versions = {**manifest.versions, **{b: version for b in changed}}
            after = Manifest(versions, buckets, version)
            rows = merged.where(F.col("bucket").isin(*sorted(changed)))
            _write(rows, root, schema, key, after, max(changed.values()))
            _publish(spark, root, after)
    finally:
        merged.unpersist()
    return totals
