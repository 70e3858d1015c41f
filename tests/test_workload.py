"""Late rows of a workload stream, over restarts and replayed batches."""

import datetime as dt

from pyspark.sql import functions as F

from millwatch.streaming import workload

ROWS = "created_at timestamp, risk_tier string"


def at(day, hour):
    return dt.datetime(2024, 3, day, hour)


def send(spark, folder, *rows):
    spark.createDataFrame(list(rows), ROWS).write.mode("append").parquet(f"{folder}/log")
    log = spark.readStream.schema(ROWS).parquet(f"{folder}/log")
    workload.start(log, workload.WorkloadPaths(f"{folder}/out")).awaitTermination()


def state(spark, folder):
    paths = workload.WorkloadPaths(f"{folder}/out")
    windows = workload.read_windows(spark, paths).select(F.dayofmonth("window_start").alias("d"), "n_rows", "n_flagged", "is_open")
    late = workload.read_late(spark, paths, ROWS)
    return {r["d"]: (r["n_rows"], r["n_flagged"], r["is_open"]) for r in windows.collect()}, late


def test_rows_are_in_a_window_or_late(spark, folder):
    send(spark, folder, (at(1, 5), "low"), (at(1, 23), "high"), (None, "low"))
    windows, late = state(spark, folder)
    assert windows == {1: (2, 1, True)} and late.count() == 1
    # A batch does not move its own watermark: the row of day 1 still counts.
    send(spark, folder, (at(3, 2), "elevated"), (at(1, 8), "low"))
    windows, late = state(spark, folder)
    assert windows == {1: (3, 1, False), 3: (1, 1, True)} and late.count() == 1
    # Day 1 has ended; day 2 had no rows but has ended too; the watermark never goes back.
    send(spark, folder, (at(1, 9), "high"), (at(2, 9), "low"), (at(2, 9), "low"))
    windows, late = state(spark, folder)
    assert windows == {1: (3, 1, False), 3: (1, 1, True)}
    assert late.where("batch = 2").count() == 3 and late.count() == 4
    # A window is closed only when the delay has passed as well.
    send(spark, folder, (dt.datetime(2024, 3, 4, 0, 30), "low"))
    send(spark, folder, (at(3, 7), "low"))
    windows, late = state(spark, folder)
    assert windows[3] == (2, 1, True) and late.count() == 4


def test_a_replayed_batch_counts_once(spark, folder):
    send(spark, folder, (at(1, 5), "low"))
    send(spark, folder, (at(3, 5), "low"))
    paths = workload.WorkloadPaths(f"{folder}/out")
    again = spark.createDataFrame([(at(3, 5), "low")], ROWS)
    workload.count_batch(again, 1, paths, "1 day", "1 hour")
    # Counts of a batch that has no mark yet are not read.
    spark.createDataFrame([(at(5, 0), at(6, 0), 7, 0, 0, 0)], "start timestamp, end timestamp, n_rows long, n_elevated long, n_high long, n_flagged long").write.parquet(
        f"{paths.counts}/stream={workload._stream_id(spark, paths)}/batch=2"
    )
    assert state(spark, folder)[0] == {1: (1, 0, False), 3: (1, 0, True)}


def test_empty_batch(spark, folder):
    send(spark, folder)
    send(spark, folder, (at(1, 5), "low"))
    windows, late = state(spark, folder)
    assert windows == {1: (1, 0, True)} and late.count() == 0
