"""The whole path on the smallest table: train, evaluate, threshold, score, monitor."""

import datetime

import pytest
from pyspark.sql import functions as F

from catalog import inputs
from millwatch import schema as S
from millwatch.operators import models, projections
from millwatch.plans import jobs
from millwatch.sources import bundles, prediction_log, results, snapshots

SPEC = models.ModelSpec("forest", trees=8, depth=6, bins=32)


@pytest.fixture(scope="module")
def readings(spark, sf_dir):
    return inputs.readings(spark, sf_dir)


@pytest.fixture(scope="module")
def bundle(spark, readings, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("bundle"))
    return out, jobs.train(readings, out, "run1", SPEC)


def test_training_scores_every_training_row_out_of_fold(spark, readings, bundle):
    out, notes = bundle
    oof = spark.read.parquet(f"{out}/oof")
    assert oof.count() == notes["n_train"] and oof.select("udi").distinct().count() == notes["n_train"]
    assert oof.where(F.abs(F.aggregate("proba", F.lit(0.0), lambda a, b: a + b) - 1) > 1e-9).count() == 0
    assert oof.where(F.size("proba") != 5).count() == 0
    assert len(notes["input_example"]) == 5 and notes["classes"] == list(S.CLASSES)
    tables = ("metrics", "per_class", "confusion_counts", "confusion_normalised", "errors", "fold_std", "cv")
    assert all(spark.read.parquet(f"{out}/evaluation/{t}").columns for t in tables)
    assert spark.read.parquet(f"{out}/evaluation/fold_std").count() == 20


def test_the_path_from_threshold_to_monitoring(spark, readings, bundle, folder):
    out, notes = bundle
    chosen = jobs.choose_threshold(readings, out, 0.1)
    assert chosen["oof_healthy_flagged"] <= chosen["budget"]

    metrics = {r["metric"]: r["value"] for r in jobs.evaluate(readings, out).collect()}
    assert {"test_f1_macro", "test_balanced_accuracy", "test_false_alarms", "test_roc_auc_macro"} <= set(metrics)
    with pytest.raises(RuntimeError, match="scored its sealed rows once"):
        jobs.evaluate(readings, out)

    model = jobs.load_served(spark, out, "failure-classifier", 1)
    assert model.threshold == chosen["threshold"]
    start = datetime.datetime.now(datetime.timezone.utc)
    log_root = f"{folder}/log"
    answers = jobs.score_table(readings.select(*S.RAW_INPUTS), model, log_root, "b1")
    assert answers.count() == readings.count()

    window = jobs.monitor(spark, out, log_root, start, f"{folder}/monitor", "w1").first()
    assert window["n_current"] == readings.count() and window["n_reference"] == notes["n_train"]
    assert window["verdict"] == "no_drift"
    stored = spark.read.parquet(f"{folder}/monitor/monitor_column_drift")
    assert stored.count() == 9 and stored.first()["window_id"] == "w1"
    later = start + datetime.timedelta(days=1)
    empty = jobs.monitor(spark, out, log_root, later, f"{folder}/monitor", "w2").first()
    assert empty["verdict"] == "insufficient_data" and empty["share_low"] is None
    with pytest.raises(ValueError, match="timezone"):
        jobs.monitor(spark, out, log_root, datetime.datetime(2026, 1, 1), folder, "w3")


def test_a_changed_test_row_stops_the_threshold_job(readings, bundle):
    out, _ = bundle
    moved = readings.withColumn("torque_nm", F.nanvl("torque_nm", F.lit(0.0)) + 1e-9)
    with pytest.raises(RuntimeError, match="not the rows sealed"):
        jobs.choose_threshold(moved, out)


def test_boosted_model_saves_loads_and_sums_to_one(spark, readings, folder):
    training = projections.training_rows(readings)
    model = models.fit_training_rows(training, models.boosted_spec(rounds=2, depth=3))
    inputs = training.select(*S.FEATURES)
    bundles.save_model(model, folder, bundles.Signature.of(inputs, models.score(model, inputs)))
    inputs9 = projections.model_input(readings, "udi")
    before = models.score(model, inputs9)
    after = models.score(bundles.load_model(folder), inputs9)
    assert before.exceptAll(after).count() == 0 and before.columns == ["udi", *S.FEATURES, "proba"]
    total = F.aggregate("proba", F.lit(0.0), lambda a, b: a + b)
    assert before.where(F.abs(total - 1) > 1e-9).count() == 0


def test_a_part_without_a_class_still_gives_five_probabilities(readings):
    training = projections.training_rows(readings).where("failure_type in ('no_failure', 'PWF')")
    model = models.fit_training_rows(training, SPEC)
    row = models.score(model, training).first()
    assert len(row["proba"]) == 5 and row["proba"][4] == 0.0


def test_unknown_grade_fails_scoring(spark, readings, bundle):
    out, _ = bundle
    model = bundles.load_model(out)
    wrong = projections.model_input(readings.limit(3).withColumn("type", F.lit("Z")))
    with pytest.raises(Exception, match="Unknown grade: Z"):
        models.score(model, wrong).collect()


def test_model_kind_is_checked():
    with pytest.raises(ValueError, match="Unknown model kind"):
        models.ModelSpec("linear")


def test_readings_table_round_trip(spark, readings, folder):
    snapshots.upsert_table(readings, folder, buckets=4)
    assert snapshots.read_table(spark, folder).exceptAll(readings).count() == 0
    assert prediction_log.reading_by_udi(snapshots.read_table(spark, folder), 5).count() == 1
    assert results.evaluation_tables
