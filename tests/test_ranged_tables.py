"""Tables of key ranges: what an upsert changes, reads and exchanges, and when it is refused."""

import re
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import toys
from millwatch import schema as S
from millwatch.plans import jobs
from millwatch.sources import csv_files, ranged_tables

TOY = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.DoubleType())])


@pytest.fixture
def table(spark, folder):
    name = f"toy_{uuid.uuid4().hex}"
    ranged_tables.open_table(spark, name, f"{folder}/toy", "k", TOY, width=10, buckets=2)
    return name


def toy(spark, rows):
    return spark.createDataFrame(rows, TOY)


def held(spark, name):
    return {r["k"]: r["v"] for r in ranged_tables.read_table(spark, name).collect()}


def test_inserts_updates_nulls_and_negative_keys(spark, table):
    nan = float("nan")
    first = [(-11, 1.0), (-1, None), (0, nan), (9, 2.0), (10, 3.0), (35, 4.0)]
    done = ranged_tables.upsert_table(toy(spark, first), table)
    assert (done.insert, done.update, done.unchanged, done.ranges_read, done.ranges_written) == (6, 0, 0, 0, 5)
    again = ranged_tables.upsert_table(toy(spark, first), table)
    assert (again.insert, again.update, again.unchanged, again.ranges_read, again.ranges_written) == (0, 0, 6, 5, 0)
    # Null to a value, a value to null, one new key; range 1 is read and left alone, range 3 is not read.
    done = ranged_tables.upsert_table(toy(spark, [(-1, 5.0), (9, None), (8, 6.0), (10, 3.0)]), table)
    assert (done.insert, done.update, done.unchanged, done.ranges_read, done.ranges_written) == (1, 2, 1, 3, 2)
    rows = held(spark, table)
    assert rows.pop(0) != rows.get(0) and rows == {-11: 1.0, -1: 5.0, 8: 6.0, 9: None, 10: 3.0, 35: 4.0}
    found = ranged_tables.read_keys(spark, table, [-1, 35, 36]).collect()
    assert sorted(r["k"] for r in found) == [-1, 35]


def test_ranges_that_did_not_change_keep_their_files(spark, table):
    ranged_tables.upsert_table(toy(spark, [(k, float(k)) for k in range(40)]), table)

    def files():
        rows = spark.table(table).select(ranged_tables.RANGE, F.input_file_name().alias("f")).distinct().collect()
        return {place: {r["f"] for r in rows if r[ranged_tables.RANGE] == place} for place in range(4)}

    before = files()
    done = ranged_tables.upsert_table(toy(spark, [(k, 0.5) for k in (20, 23)] + [(31, 31.0)]), table)
    after = files()
    assert (done.update, done.unchanged, done.ranges_read, done.ranges_written) == (2, 1, 2, 1)
    assert [before[p] == after[p] for p in range(4)] == [True, True, False, True]


def test_only_the_batch_is_exchanged(spark, table):
    """Neither join moves the table, and ranges without rows of the batch are not listed."""
    ranged_tables.upsert_table(toy(spark, [(k, float(k)) for k in range(40)]), table)
    target = spark.table(table).where(F.col(ranged_tables.RANGE).isin(2, 3))
    batch = toy(spark, [(21, 1.0), (39, 2.0)]).withColumn(ranged_tables.RANGE, ranged_tables.range_of("k", 10))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for joined in (ranged_tables.marked_batch(target, batch, "k"), ranged_tables.merged_rows(target, batch, "k")):
            plan = joined._jdf.queryExecution().executedPlan().toString()
            scan = re.search(r"FileScan parquet.*", plan)[0]
            assert "Bucketed: true" in scan and "key_range" in scan and "2 paths" in scan
            branches = re.split(r"\n\s*(?=[:+ ]*[+:]- Sort)", plan)
            moved = [b for b in branches if "Exchange" in b]
            assert len(moved) == 1 and "FileScan" not in moved[0] and plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_refused_batches_leave_the_table(spark, table, folder):
    ranged_tables.upsert_table(toy(spark, [(1, 1.0)]), table)
    with pytest.raises(ValueError, match="k 2 occurs 2 times"):
        ranged_tables.upsert_table(toy(spark, [(2, 1.0), (2, 2.0)]), table)
    with pytest.raises(Exception, match="k_not_null"):
        ranged_tables.upsert_table(toy(spark, [(None, 1.0)]), table)
    assert ranged_tables.upsert_table(toy(spark, []), table).ranges_read == 0
    assert held(spark, table) == {1: 1.0}
    with pytest.raises(ValueError, match="range width and buckets"):
        ranged_tables.open_table(spark, table, f"{folder}/toy", "k", TOY, width=20, buckets=2)
    text = T.StructType([T.StructField("k", T.StringType())])
    with pytest.raises(TypeError, match="whole number"):
        ranged_tables.open_table(spark, "other", f"{folder}/other", "k", text)


def test_a_new_session_opens_the_folder_again(spark, table, folder):
    ranged_tables.upsert_table(toy(spark, [(1, 1.0), (15, 2.0)]), table)
    spark.sql(f"DROP TABLE {table}")
    ranged_tables.open_table(spark, table, f"{folder}/toy", "k", TOY, width=10, buckets=2)
    done = ranged_tables.upsert_table(toy(spark, [(15, 2.0), (16, 3.0)]), table)
    assert (done.insert, done.unchanged, done.ranges_read) == (1, 1, 1)
    assert held(spark, table) == {1: 1.0, 15: 2.0, 16: 3.0}


def test_ingest_into_ranges(spark, folder):
    """A file that breaks rules loads nothing and leaves no scratch table; a good one loads once."""
    name = f"readings_{uuid.uuid4().hex}"
    ranged_tables.open_table(spark, name, f"{folder}/table", width=100, buckets=2)
    rows = toys.readings_frame(spark, [(i, {"torque_nm": 20.0 + i}) for i in (5, 105, 106, 250)])
    csv_files.write_raw(rows, f"{folder}/good")
    csv_files.write_raw(rows.unionByName(rows.where("udi = 5")).withColumn("type", F.lit("Q")), f"{folder}/bad")
    csv_files.write_raw(rows.limit(0), f"{folder}/none")
    with pytest.raises(ValueError, match=r"type_domain \(5 rows\); udi_unique \(1 rows\)"):
        jobs.ingest_ranges(spark, f"{folder}/bad", name)
    assert ranged_tables.read_table(spark, name).count() == 0
    assert jobs.ingest_ranges(spark, f"{folder}/good", name).insert == 4
    done = jobs.ingest_ranges(spark, f"{folder}/good", name)
    assert (done.unchanged, done.ranges_read, done.ranges_written) == (4, 3, 0)
    stored = ranged_tables.read_table(spark, name)
    assert stored.columns == S.READINGS_SCHEMA.names and stored.exceptAll(rows).count() == 0


def test_a_batch_too_large_for_its_buckets_is_dealt_to_more_tasks(spark, table, monkeypatch):
    """No task of a join holds most of a bucket, nothing is exchanged twice, and a bucket of a range is one file as before."""
    monkeypatch.setattr(ranged_tables, "TASK_ROWS", 50)
    merged, made = ranged_tables.merged_rows, []
    monkeypatch.setattr(ranged_tables, "merged_rows", lambda *a, **b: made.append(merged(*a, **b)) or made[-1])
    keys = spark.range(-500, 500).select(F.col("id").alias("k"))
    done = ranged_tables.upsert_table(keys.withColumn("v", F.lit(1.0)), table)
    assert (done.insert, done.ranges_read, done.ranges_written) == (1000, 0, 100)
    batch = keys.where("k < 400").union(spark.range(500, 520)).withColumn("v", F.when(F.pmod("k", F.lit(20)) < 10, 1.0).otherwise(F.col("k")))
    done = ranged_tables.upsert_table(batch, table)
    assert (done.insert, done.update, done.unchanged, done.ranges_read, done.ranges_written) == (20, 450, 450, 90, 47)
    assert held(spark, table) == {k: 1.0 if k % 20 < 10 or 400 <= k < 500 else float(k) for k in range(-500, 520)}
    files = spark.table(table).select(ranged_tables.RANGE, F.input_file_name().alias("f")).distinct()
    assert files.groupBy(ranged_tables.RANGE).count().agg(F.max("count")).first()[0] == 2
    load, change = made
    sizes = [r["count"] for r in load.groupBy(F.spark_partition_id()).agg(F.count("v").alias("count")).collect()]
    assert len(sizes) > 10 and max(sizes) <= 150
    plan = change._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2 and plan.count("REPARTITION_BY_NUM") == 2
