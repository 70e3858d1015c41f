"""The jobs: ingest, train, evaluate, choose a threshold, score and monitor."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch import schema as S
from millwatch.operators import (
    drift,
    evaluation,
    integrity,
    models,
    projections,
    quality,
    reconcile,
    risk,
    splits,
)
from millwatch.session import discard, materialise, scratch_path
from millwatch.sources import bundles, csv_files, prediction_log, ranged_tables, results, snapshots
from millwatch.streaming import scoring

THRESHOLD_RULE = (
    "smallest score t that flags at most budget_fraction of the healthy training rows, "
    "judged on out-of-fold scores; a row is elevated if its score is above t"
)


def ingest(spark: SparkSession, csv_path: str, table: str, buckets: int | None = None) -> dict[str, int]:
    """Load CSV files into the readings table; returns rows per action."""
    with _staged(spark, csv_path) as batch:
        return snapshots.upsert_table(batch, table, buckets=buckets, proven_unique=True)


def ingest_ranges(spark: SparkSession, csv_path: str, name: str) -> ranged_tables.Upserted:
    """Load CSV files into an opened table of key ranges."""
    with _staged(spark, csv_path) as batch:
        return ranged_tables.upsert_table(batch, name, proven_unique=True)


@contextmanager
def _staged(spark: SparkSession, csv_path: str) -> Iterator[DataFrame]:
    """A valid batch as a scratch table, which goes when the batch is loaded.

    The CSV is parsed once (its header is read before, and flags and texts are
    typed on the way): the write that stages it counts the rules.
    """
    path = scratch_path(spark, "staged")
    try:
        batch, seen = quality.observed_batch(csv_files.read_batch(spark, csv_path))
        batch.write.parquet(path)
        staged = spark.read.schema(batch.schema).parquet(path)
        quality.require_clean(quality.written_counts(seen, staged))
        yield quality.flags_to_bool(staged)
    finally:
        discard(spark, path)


def _parts(labelled: DataFrame, cuts: splits.QuotaCuts) -> tuple[DataFrame, DataFrame]:
    assigned = cuts.assign(labelled, "split")
    train = assigned.where(F.col("split") == "train").drop("split")
    return train, assigned.where(F.col("split") == "test").drop("split")


def train(
    readings: DataFrame, out: str, run_id: str, spec: models.ModelSpec = models.ModelSpec()
) -> dict:
    """Cross-validate, fit on all training rows and save model, cuts and tables.

    The test rows are fingerprinted here and never scored.
    """
    spark = readings.sparkSession
    labelled = projections.training_rows(readings)
    cuts = splits.split_cuts(labelled)
    training, sealed = _parts(labelled, cuts)
    example = training.select("udi", *S.FEATURES).orderBy("udi").drop("udi").limit(5)

    folds = splits.fold_cuts(training)
    folded = folds.assign(training, "fold").withColumn("fold", F.col("fold").cast("int"))
    shared, bins = models.shared_table(folded, spec, ("udi", "failure_type", "fold"))
    oof = models.out_of_fold(shared, spec)
    oof.select("udi", "failure_type", "y", "fold", "proba").write.mode("overwrite").parquet(f"{out}/oof")
    scored = spark.read.parquet(f"{out}/oof")

    tables = results.evaluation_tables(scored, "oof")
    tables["fold_std"] = evaluation.metric_long(evaluation.fold_std(scored), "cv", "_std")
    cv = evaluation.cv_scores(scored)
    tables["cv"] = cv.unpivot([], cv.columns, "metric", "value")
    results.write_evaluation(tables, f"{out}/evaluation", run_id)

    model = models.fit(shared, spec, bins)
    inputs = training.select(*S.FEATURES)
    bundles.save_model(model, out, bundles.Signature.of(inputs, models.score(model, inputs)), spark)
    drift.reference_profile(training).write.mode("overwrite").parquet(f"{out}/reference_profile")
    notes = {
        "run_id": run_id,
        "spec": asdict(spec),
        "classes": list(S.CLASSES),
        "inputs": list(S.FEATURES),
        "input_example": [r.asDict() for r in example.collect()],
        "split": cuts.to_dict(),
        "n_train": sum(shares[0] for shares in cuts.quotas.values()),
        "n_test": sum(shares[1] for shares in cuts.quotas.values()),
        "test_fingerprint": integrity.fingerprint_hex(sealed, *integrity.sealed_columns()),
    }
    bundles.write_notes(spark, out, "training", notes)
    return notes


def _rebuilt(readings: DataFrame, notes: dict) -> tuple[DataFrame, DataFrame]:
    """Training and test rows as they were at training, or an error."""
    cuts = splits.QuotaCuts.from_dict(notes["split"])
    training, sealed = _parts(projections.training_rows(readings), cuts)
    integrity.verify_fingerprint(sealed, notes["test_fingerprint"], *integrity.sealed_columns())
    return training, sealed


def evaluate(readings: DataFrame, out: str) -> DataFrame:
    """Score the sealed test rows once with the saved model; returns its metrics."""
    spark = readings.sparkSession
    notes = bundles.read_notes(spark, out, "training")
    if bundles.has_notes(spark, out, "sealed_test"):
        raise RuntimeError(f"Run {notes['run_id']} has scored its sealed rows once; train a new run to score them again")
    _, sealed = _rebuilt(readings, notes)
    encoded = projections.encode_labels(sealed)
    scored = materialise(bundles.load_scorer(spark, out)(encoded))
    tables = results.evaluation_tables(scored, "test", sealed=True)
    results.write_evaluation(tables, f"{out}/sealed", notes["run_id"])
    bundles.write_notes(spark, out, "sealed_test", {"run_id": notes["run_id"]})
    return spark.read.parquet(f"{out}/sealed/metrics/run_id={notes['run_id']}")


def choose_threshold(
    readings: DataFrame, out: str, budget_fraction: float = S.BUDGET_FRACTION
) -> dict:
    """Set the review threshold from the stored out-of-fold scores.

    The stored scores must cover the training rows and reproduce the stored matrix.
    """
    spark = readings.sparkSession
    notes = bundles.read_notes(spark, out, "training")
    training, _ = _rebuilt(readings, notes)
    scored = spark.read.parquet(f"{out}/oof")
    reconcile.require_aligned(scored, training)
    logged = spark.read.parquet(
        f"{out}/evaluation/confusion_counts/run_id={notes['run_id']}"
    )
    reconcile.require_reproduced(evaluation.confusion_counts(scored), logged, notes["run_id"])
    choice = risk.choose_threshold(scored, budget_fraction)
    tiered = risk.assign_tiers(scored, choice.threshold)
    flags = risk.flag_counts(tiered).first()
    share = tiered.agg(F.avg((F.col("risk_tier") != "low").cast("double"))).first()[0]
    chosen = {
        **asdict(choice),
        "budget_fraction": budget_fraction,
        "threshold_rule": THRESHOLD_RULE,
        "oof_healthy_flagged": flags["healthy_flagged"],
        "oof_twf_flagged": flags["twf_flagged"],
        "expected_flagged_share": share,
    }
    bundles.write_notes(spark, out, "threshold", chosen)
    return chosen


def load_served(spark: SparkSession, out: str, name: str, version: int) -> scoring.Served:
    """The saved model with its threshold, ready for batches or streams."""
    chosen = bundles.read_notes(spark, out, "threshold")
    return scoring.Served(bundles.load_scorer(spark, out), chosen["threshold"], name, version)


def score_table(
    readings: DataFrame, served: scoring.Served, log_root: str, batch_id: str
) -> DataFrame:
    """Score a table of readings in one batch, log it, and return the recommendations."""
    records = scoring.score_requests(readings, served)
    return risk.recommendations(prediction_log.append(records, log_root, batch_id))


def monitor(
    spark: SparkSession,
    out: str,
    log_root: str,
    since: datetime.datetime,
    results_root: str,
    window_id: str,
) -> DataFrame:
    """Compare the requests logged since a cutoff with the training rows.

    The training rows are read as the profile stored with the model, which never
    saw the sealed test rows; the work of a run grows with its window alone.
    """
    prediction_log.require_aware(since)
    expected = bundles.read_notes(spark, out, "threshold")["expected_flagged_share"]
    reference = spark.read.parquet(f"{out}/reference_profile")
    current = prediction_log.window_scan(prediction_log.read_log(spark, log_root, since), since)
    window, verdicts = drift.drift_window(
        reference, current, since.isoformat(), expected_flagged=expected
    )
    results.log_window(window, verdicts, results_root, window_id)
    return window
