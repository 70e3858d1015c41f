import datetime

import pytest
from pyspark.sql import functions as F

import toys
from millwatch import schema as S
from millwatch.operators import quality, risk, upsert
from millwatch.plans import jobs
from millwatch.sources import csv_files, prediction_log, snapshots

HEADER = ",".join(S.CSV_COLUMNS)


def write_csv(folder, *lines, name="a.csv"):
    path = f"{folder}/{name}"
    with open(path, "w", encoding="utf-8-sig") as out:
        out.write("\n".join(lines) + "\n")
    return path


def test_csv_with_bom_and_null_tokens(spark, folder):
    path = write_csv(
        folder, HEADER, "1,M70311,M,301.7,311.2,1694,33.5,12,0,0,0,0,0,0",
        "2,L20964,L,NA,310.4,1277,58.9,143,1,0,0,1,0,0", "3,H55102,H,302.3,n/a,17o3,21.4,9,0,0,0,0,0,0",
    )
    rows = csv_files.read_batch(spark, path).orderBy("udi").collect()
    assert rows[0]["air_temp_k"] == 301.7 and rows[0]["rotational_speed_rpm"] == 1694
    assert rows[1]["air_temp_k"] is None and rows[1]["pwf"] == 1
    assert rows[2]["process_temp_k"] is None and rows[2]["rotational_speed_rpm"] is None


def test_flags_may_be_written_as_decimals_but_not_as_halves(spark, folder):
    row = "M70311,M,301.7,311.2,1694,33.5,12,1.0,0,0,0,0"
    good = write_csv(folder, HEADER, f"1,{row},0.0", name="good.csv")
    batch = csv_files.read_batch(spark, good)
    quality.require_valid(batch)
    assert quality.flags_to_bool(batch).first()["machine_failure"] is True
    half = write_csv(folder, HEADER, f"1,{row},0.5", name="half.csv")
    with pytest.raises(ValueError, match=r"again: rnf_binary \(1 rows\)$"):
        quality.require_valid(csv_files.read_batch(spark, half))


def test_wrong_header_fails(spark, folder):
    path = write_csv(folder, HEADER.replace("UDI", "ID"), "1,M70311,M,301.7,311.2,1694,33.5,12,0,0,0,0,0,0")
    with pytest.raises(ValueError, match=r"add \['UDI'\], drop \['ID'\]"):
        csv_files.read_batch(spark, path)


def test_ingest_is_idempotent_and_repairs_one_corruption(spark, folder):
    lines = [f"{i},M{i:05d},M,301.7,311.2,1694,{40 + i / 10},0,0,0,0,0,0,0" for i in range(1, 201)]
    path = write_csv(folder, HEADER, *lines)
    table = f"{folder}/table"
    assert jobs.ingest(spark, path, table, buckets=4) == {"insert": 200, "update": 0, "unchanged": 0}
    assert jobs.ingest(spark, path, table, buckets=4) == {"insert": 0, "update": 0, "unchanged": 200}
    broken = snapshots.read_table(spark, table).where("udi = 7").withColumn("torque_nm", F.lit(1.0))
    assert snapshots.upsert_table(broken, table, buckets=4)["update"] == 1
    assert jobs.ingest(spark, path, table, buckets=4) == {"insert": 0, "update": 1, "unchanged": 199}
    stored = snapshots.read_table(spark, table)
    assert stored.count() == 200 and stored.where("udi = 7").first()["torque_nm"] == 40.7
    # A smaller file deletes nothing.
    part = write_csv(folder, HEADER, *lines[:5], name="b.csv")
    assert jobs.ingest(spark, part, table, buckets=4) == {"insert": 0, "update": 0, "unchanged": 5}
    assert snapshots.read_table(spark, table).count() == 200


def test_a_repeated_key_is_refused_before_any_join(spark, folder):
    rows = toys.readings_frame(spark, [(1, {}), (2, {}), (2, {"torque_nm": 1.0})])
    with pytest.raises(ValueError, match="udi 2 occurs 2 times"):
        snapshots.upsert_table(rows, folder)


def test_invalid_file_loads_nothing(spark, folder):
    path = write_csv(
        folder, HEADER, "1,M70311,M,301.7,311.2,1694,33.5,12,0,0,0,0,0,2",
        "1,M1,Q,301.7,311.2,1694,33.5,12,0,0,0,0,0,0",
    )
    with pytest.raises(ValueError, match="product_id_length.*rnf_binary.*type_domain.*udi_unique"):
        jobs.ingest(spark, path, f"{folder}/table")
    assert snapshots.read_table(spark, f"{folder}/table").count() == 0


def test_upsert_treats_null_and_nan_as_equal_to_themselves(spark):
    schema = "k int, x double, s string"
    target = spark.createDataFrame([(1, float("nan"), None), (2, 1.0, "a"), (3, 2.0, None)], schema)
    staged = spark.createDataFrame([(1, float("nan"), None), (2, 1.0, None), (4, None, "n")], schema)
    rows = {r["k"]: r for r in upsert.upsert_rows(target, staged, "k").collect()}
    assert {k: r["action"] for k, r in rows.items()} == {1: "unchanged", 2: "update", 3: "keep", 4: "insert"}
    assert rows[2]["s"] is None and rows[3]["x"] == 2.0 and rows[4]["s"] == "n"


def test_log_keys_are_checked_both_ways(spark, folder):
    df = toys.log_frame(spark, {}).drop("risk_tier").withColumn("action", F.lit("stop"))
    with pytest.raises(ValueError, match=r"add \['risk_tier'\], drop \['action'\]"):
        prediction_log.append(df, folder, 0)


def test_append_assigns_ids_and_never_writes_a_batch_twice(spark, folder):
    first = prediction_log.append(toys.log_frame(spark, {}, {}), folder, 0)
    assert first.columns == list(S.LOG_SCHEMA.names) and len(first.columns) == 23
    ids = {r["request_id"] for r in first.collect()}
    assert len(ids) == 2 and {len(i) for i in ids} == {36}
    again = prediction_log.append(toys.log_frame(spark, {}, {}, {}), folder, 0)
    assert {r["request_id"] for r in again.collect()} == ids
    prediction_log.append(toys.log_frame(spark, {}), folder, 1)
    assert prediction_log.read_log(spark, folder).count() == 3


def test_an_unfinished_batch_is_not_read(spark, folder):
    """A folder without its success marker is what a job leaves that died on the way."""
    prediction_log.append(toys.log_frame(spark, {}), folder, "a")
    spark.conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        prediction_log.append(toys.log_frame(spark, {}, {}), folder, "b")
    finally:
        spark.conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")
    assert not prediction_log.is_committed(spark, folder, "b")
    assert {r["batch_id"] for r in prediction_log.read_log(spark, folder).collect()} == {"a"}
    prediction_log.append(toys.log_frame(spark, {}, {}), folder, "b")
    assert prediction_log.read_log(spark, folder).count() == 3


def test_a_window_lists_only_its_dates(spark, folder):
    prediction_log.append(toys.log_frame(spark, {}), folder, 1)
    now = datetime.datetime.now(datetime.timezone.utc)
    assert prediction_log.read_log(spark, folder, now - datetime.timedelta(days=2)).count() == 1
    assert prediction_log.read_log(spark, folder, now + datetime.timedelta(days=3)).inputFiles() == []


def test_padded_texts_break_their_rules(spark, folder):
    path = write_csv(folder, HEADER, "1,H55102, H ,302.3, 312.9 ,1703,21.4,9,0,0,0,0,0,0", "2, M70311,M,301.7,311.2,1694,33.5,12,0,0,0,0,0,0")
    batch = csv_files.read_batch(spark, path)
    broken = {r["rule"]: r["n_bad"] for r in quality.validate_batch(batch).where("n_bad > 0").collect()}
    assert broken == {"type_domain": 1, "product_id_length": 1}
    assert batch.where("udi = 1").first()["process_temp_k"] == 312.9


def test_the_number_of_buckets_stays_until_the_table_is_rebucketed(spark, folder):
    rows = toys.readings_frame(spark, [(i, {}) for i in range(40)])
    assert snapshots.upsert_table(rows, folder, buckets=8)["insert"] == 40
    with pytest.raises(ValueError, match="has 8 buckets, not 5"):
        snapshots.upsert_table(rows, folder, buckets=5)
    assert snapshots.upsert_table(rows, folder) == {"insert": 0, "update": 0, "unchanged": 40}
    snapshots.rebucket_table(spark, folder, 5)
    assert snapshots.upsert_table(rows, folder, buckets=5) == {"insert": 0, "update": 0, "unchanged": 40}
    table = snapshots.read_table(spark, folder)
    assert table.count() == 40 and table.select("udi").distinct().count() == 40
    found = snapshots.read_key(spark, folder, 17)
    assert found.count() == 1 and len(found.inputFiles()) < len(table.inputFiles())
    assert snapshots.read_key(spark, folder, 4000).count() == 0


def test_large_buckets_become_several_files(spark, folder, monkeypatch):
    monkeypatch.setattr(snapshots, "ROWS_PER_FILE", 30)
    rows = toys.readings_frame(spark, [(i, {}) for i in range(200)])
    snapshots.upsert_table(rows, folder, buckets=1)
    table = snapshots.read_table(spark, folder)
    assert len(table.inputFiles()) > 3 and table.count() == 200


@pytest.mark.parametrize(("change", "name"), [({"type": "Q"}, "type_domain"), ({"product_id": "M1"}, "product_id_length"), ({"torque_nm": None}, "torque_nm_not_null")])
def test_the_table_keeps_its_own_constraints(spark, folder, change, name):
    rows = toys.readings_frame(spark, [(1, {}), (2, {})])
    for column, value in change.items():
        rows = rows.withColumn(column, F.when(F.col("udi") == 2, F.lit(value)).otherwise(F.col(column)))
    with pytest.raises(Exception, match=name):
        snapshots.upsert_table(rows, folder)
    assert snapshots.read_table(spark, folder).count() == 0


def test_a_broken_row_commits_nothing(spark, folder):
    with pytest.raises(Exception, match="predictions_log_type_check"):
        prediction_log.append(toys.log_frame(spark, {}, {"type": "X"}), folder, 0)
    assert not prediction_log.is_committed(spark, folder, 0)


def test_cutoff_is_inclusive_and_must_be_aware(spark, folder):
    prediction_log.append(toys.log_frame(spark, {}, {"confidence_score": 0.8, "risk_tier": "elevated"}), folder, 0)
    log = prediction_log.read_log(spark, folder)
    latest = log.agg(F.max(F.unix_micros("created_at"))).first()[0]
    utc = datetime.timezone.utc
    at = datetime.datetime.fromtimestamp(0, utc) + datetime.timedelta(microseconds=latest)
    current = prediction_log.window_scan(log, at)
    assert current.count() >= 1 and current.columns == [*S.FEATURES, "risk_tier", "predicted_mode"]
    india = at.astimezone(datetime.timezone(datetime.timedelta(hours=5, minutes=30)))
    assert prediction_log.window_scan(log, india).count() == current.count()
    assert prediction_log.window_scan(log, at + datetime.timedelta(seconds=1)).count() == 0
    for scan in (prediction_log.window_scan, prediction_log.since_rows):
        with pytest.raises(ValueError, match="timezone"):
            scan(log, datetime.datetime(2026, 10, 4))


def test_response_has_exactly_the_published_fields(spark, folder):
    answers = risk.recommendations(prediction_log.append(toys.log_frame(spark, {}), folder, 0))
    assert set(answers.columns) == {
        "request_id", "created_at", "model_name", "model_version", "flagged", "risk_tier",
        "confidence_score", "predicted_mode", "predicted_probability", "runner_up_mode",
        "runner_up_probability", "class_probabilities", "physics_features",
    }
    row = answers.first()
    assert row["predicted_probability"] == 0.5 and row["runner_up_probability"] == 0.25
    assert row["class_probabilities"].asDict() == {
        "no_failure": 0.5, "TWF": 0.0625, "HDF": 0.25, "PWF": 0.125, "OSF": 0.0625}
    assert set(row["physics_features"].asDict()) == set(S.PHYSICS)
    assert quality.annotate(answers, quality.response_checks()).first()["violations"] == []


def test_an_append_looks_at_one_path_however_old_its_batch_is(spark, folder, monkeypatch):
    """A replay days later finds the batch by its note; no date is listed."""
    first = prediction_log.append(toys.log_frame(spark, {}), folder, "old")
    ids = {r["request_id"] for r in first.collect()}
    later = datetime.datetime.now(datetime.timezone.utc) + datetime.timedelta(days=9)

    class Clock(datetime.datetime):
        @classmethod
        def now(cls, tz=None):
            return later

    monkeypatch.setattr(prediction_log.datetime, "datetime", Clock)
    monkeypatch.setattr(prediction_log, "matching_paths", lambda *_: pytest.fail("an append lists the log"))
    again = prediction_log.append(toys.log_frame(spark, {}), folder, "old")
    assert {r["request_id"] for r in again.collect()} == ids and prediction_log.is_committed(spark, folder, "old")


def test_a_batch_that_broke_off_is_written_again_on_its_first_date(spark, folder):
    path = prediction_log._begin(spark, folder, "x")
    assert not prediction_log.is_committed(spark, folder, "x")
    note = prediction_log._note(folder, "x")
    spark.createDataFrame([("2020-02-03",)], "value string").write.mode("overwrite").text(note)
    prediction_log.append(toys.log_frame(spark, {}), folder, "x")
    assert {str(r["log_date"]) for r in prediction_log.read_log(spark, folder).collect()} == {"2020-02-03"} and "2020" not in path


def test_a_reader_names_dates_and_not_batches(spark, folder, monkeypatch):
    for k in range(5):
        prediction_log.append(toys.log_frame(spark, {}), folder, k)
    (path,) = {f.rpartition("/")[0] for f in prediction_log.append(toys.log_frame(spark, {}), folder, 9).inputFiles()}
    spark.createDataFrame([(1,)], "x int").write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    given = []
    read = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *paths, **k: given.extend(paths) or read(self, *paths, **k))
    assert {r["batch_id"] for r in prediction_log.read_log(spark, folder).collect()} == set("01234") and len(given) == 1


def test_an_id_lookup_is_pushed_to_the_files(spark, folder):
    prediction_log.append(toys.log_frame(spark, {}), folder, 0)
    plan = prediction_log.row_by_request(prediction_log.read_log(spark, folder), "x")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(request_id,x)" in plan
