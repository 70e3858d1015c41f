"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query runs over the whole derived tables. Where an operator needs faulty
or shifted data, the fault is a rule on the id that leaves every row in place.
"""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalog import inputs as I
from millwatch import schema as S
from millwatch.functions import classes, physics
from millwatch.operators import (
    audits,
    binning,
    day_profiles,
    drift,
    evaluation,
    integrity,
    models,
    projections,
    quality,
    reconcile,
    risk,
    split_audit,
    splits,
    table_diff,
    upsert,
)
from millwatch.session import materialise, scratch_path
from millwatch.sources import bundles, csv_files, prediction_log, ranged_tables, results, snapshots
from millwatch.streaming import scoring, workload

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CUTOFF = datetime.datetime(2024, 1, 20, tzinfo=datetime.timezone.utc)
BUDGET = 0.10
WINDOW_SIZES = (100, 200, 300, 500, 750, 1000)
WINDOWS_PER_SIZE = 200
FAULT_K = 2.0
ROUNDING = 6


def query(function: Query) -> Query:
    QUERIES[function.__name__.rstrip("_")] = function
    return function


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, ROUNDING) for c in columns})


def _time_text(column: str = "created_at") -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def _every(n: int, hit: int = 0) -> Column:
    return F.col("udi") % n == hit


# --- scans, sources and sinks ---------------------------------------------------


@query
def csv_scan(spark, sf):
    path = scratch_path(spark, "csv")
    csv_files.write_raw(I.readings(spark, sf), path)
    return quality.flags_to_bool(csv_files.read_batch(spark, path))


@query
def column_contract(spark, sf):
    raw = I.readings(spark, sf).select(
        *[F.col(name).alias(header) for header, name in reversed(S.CSV_COLUMNS.items())]
    )
    return quality.column_contract(raw)


@query
def training_scan(spark, sf):
    return I.training(spark, sf)


@query
def readings_schema(spark, sf):
    root = scratch_path(spark, "table")
    snapshots.upsert_table(I.readings(spark, sf), root, buckets=8)
    return snapshots.read_table(spark, root)


def _upsert_sides(spark, sf):
    readings = I.readings(spark, sf)
    target = readings.where(~_every(10))
    torque = F.when(_every(7), F.col("torque_nm") + 0.5).otherwise(F.col("torque_nm"))
    return target, readings.withColumn("torque_nm", torque)


@query
def upsert_diff(spark, sf):
    return upsert.upsert_actions(*_upsert_sides(spark, sf), "udi")


@query
def upsert_(spark, sf):
    return upsert.upsert_rows(*_upsert_sides(spark, sf), "udi")


@query
def upsert_rerun(spark, sf):
    """Load, upsert a batch, and run the same batch again: nothing changes."""
    target, staged = _upsert_sides(spark, sf)
    root = scratch_path(spark, "table")
    rows = []
    for run, batch in (("load", target), ("batch", staged), ("rerun", staged)):
        done = snapshots.upsert_table(batch, root, buckets=8 if run == "load" else None)
        rows.append((run, done["insert"], done["update"], done["unchanged"]))
    return spark.createDataFrame(
        rows, "run string, n_insert long, n_update long, n_unchanged long"
    )


@query
def rebucket(spark, sf):
    """The batch again after the table got another number of buckets: nothing changes and no key is there twice."""
    target, staged = _upsert_sides(spark, sf)
    root = scratch_path(spark, "table")
    snapshots.upsert_table(target, root, buckets=8)
    snapshots.upsert_table(staged, root)
    snapshots.rebucket_table(spark, root, 5)
    done = snapshots.upsert_table(staged, root)
    table = snapshots.read_table(spark, root)
    return table.agg(
        F.count("*").alias("n_rows"), F.countDistinct("udi").alias("n_keys"),
        F.lit(done["insert"] + done["update"]).cast("long").alias("n_changed"),
    )


def _ranged_runs(spark, sf) -> tuple[str, DataFrame]:
    """A table of key ranges after a load, a batch to every fourth range that changes every eighth, and the batch again."""
    target, _ = _upsert_sides(spark, sf)
    place = F.floor(F.col("udi") / 500)
    changes = place % 8 == 1
    staged = I.readings(spark, sf).where((place % 4 == 1) & (~_every(10) | changes))
    torque = F.when(_every(7) & changes, F.col("torque_nm") + 0.5).otherwise(F.col("torque_nm"))
    path = scratch_path(spark, "ranged")
    name = f"ranged_{path[-32:]}"
    ranged_tables.open_table(spark, name, path, width=500, buckets=2)
    rows = []
    staged = staged.withColumn("torque_nm", torque)
    for run, batch in (("load", target), ("batch", staged), ("rerun", staged)):
        done = ranged_tables.upsert_table(batch, name, proven_unique=True)
        rows.append((run, done.insert, done.update, done.unchanged, done.ranges_read, done.ranges_written))
    counts = "n_insert long, n_update long, n_unchanged long, n_ranges_read long, n_ranges_written long"
    return name, spark.createDataFrame(rows, f"run string, {counts}")


@query
def ranged_upsert(spark, sf):
    """Rows by action, and how many key ranges a load, a batch and its repetition read and write."""
    return _ranged_runs(spark, sf)[1]


@query
def ranged_rows(spark, sf):
    """What the table of key ranges holds after these batches."""
    return ranged_tables.read_table(spark, _ranged_runs(spark, sf)[0])


@query
def feature_view(spark, sf):
    return I.features(spark, sf)


@query
def log_append(spark, sf):
    records = I.log(spark, sf).select(*S.LOG_COLUMNS)
    committed = prediction_log.append(records, scratch_path(spark, "log"), 0)
    return committed.select(
        *S.LOG_COLUMNS,
        (F.length("request_id") == 36).alias("has_id"),
        F.col("created_at").isNotNull().alias("has_time"),
    )


@query
def window_scan(spark, sf):
    return prediction_log.window_scan(I.log(spark, sf), CUTOFF)


@query
def reference_scan(spark, sf):
    return splits.train_rows(I.training(spark, sf)).select(*S.FEATURES)


@query
def point_lookup(spark, sf):
    log = I.log(spark, sf)
    root = scratch_path(spark, "table")
    snapshots.upsert_table(I.readings(spark, sf), root, buckets=8)
    reading = snapshots.read_key(spark, root, 1).select("udi", "product_id")
    request_id = hashlib.md5(b"req:1").hexdigest()
    logged = prediction_log.row_by_request(log, request_id)
    total = log.agg(F.count("*")).scalar()
    found = reading.join(logged.select("udi", "request_id", "risk_tier"), "udi", "left")
    return found.withColumn("n_log_rows", total)


@query
def log_lookup(spark, sf):
    """A row of an appended log by the id it was given: the filter reaches the files, whose bloom filters hold the ids."""
    root = scratch_path(spark, "log")
    rows = I.log(spark, sf)
    batches = [prediction_log.append(rows.where(_every(2, k)).select(*S.LOG_COLUMNS), root, k) for k in (0, 1)]
    asked = batches[1].agg(F.min("request_id")).first()[0]
    log = prediction_log.read_log(spark, root)
    found = prediction_log.row_by_request(log, asked)
    columns = [*S.LOG_COLUMNS, "request_id"]
    alike = found.select(*columns).join(batches[1].where(F.col("request_id") == asked).select(*columns), columns, "left_semi").agg(F.count("*"))
    return found.agg(F.count("*").alias("n_found"), F.max("batch_id").alias("batch_id")).select(
        "n_found", "batch_id", alike.scalar().alias("n_alike"), log.agg(F.count("*")).scalar().alias("n_log_rows")
    )


def _monitored(spark, sf) -> str:
    """The sink after a healthy and a faulty window."""
    root = scratch_path(spark, "monitor")
    reference = materialise(drift.reference_profile(reference_scan(spark, sf)))
    for name, fault in (("healthy", 0.0), ("fault", FAULT_K)):
        window, verdicts = drift.drift_window(
            reference, _current_log(spark, sf, fault), CUTOFF.isoformat()
        )
        results.log_window(window, verdicts, root, name)
    return root


@query
def monitor_sink(spark, sf):
    """Two windows through the sink and back."""
    return _rounded(
        spark.read.parquet(f"{_monitored(spark, sf)}/monitor_windows"),
        "share_low", "share_elevated", "share_high", "share_flagged", "flagged_vs_expected",
    )


@query
def monitor_scores(spark, sf):
    """The column scores of those windows, and whether the window lists the column as drifted."""
    root = _monitored(spark, sf)
    scores = results.read_scores(spark, root)
    windows = spark.read.parquet(f"{root}/monitor_windows")
    listed = F.array_contains(F.split("drifted_columns", ","), F.col("column"))
    read = scores.join(windows, "window_id", "left")
    return _rounded(read.select("window_id", *scores.drop("window_id").columns, listed.alias("listed")), "score")


def _evaluated(spark, sf) -> str:
    """The sink after an out-of-fold and a sealed evaluation."""
    root = scratch_path(spark, "evaluation")
    scored = I.scored(spark, sf)
    results.write_evaluation(results.evaluation_tables(scored, "oof"), root, "cv")
    results.write_evaluation(results.evaluation_tables(scored, "test", sealed=True), root, "sealed")
    return root


@query
def evaluation_sink(spark, sf):
    """The metrics of both evaluations through the sink and back."""
    return _rounded(spark.read.parquet(f"{_evaluated(spark, sf)}/metrics"), "value")


@query
def evaluation_matrices(spark, sf):
    """Both matrices of both evaluations, cell by cell."""
    root = _evaluated(spark, sf)
    counts = spark.read.parquet(f"{root}/confusion_counts")
    shares = spark.read.parquet(f"{root}/confusion_normalised")
    return _rounded(counts.join(shares, ["run_id", "true", "predicted"], "full"), "share")


@query
def evaluation_errors(spark, sf):
    """The misclassified rows of both evaluations."""
    return spark.read.parquet(f"{_evaluated(spark, sf)}/errors")


# --- projections and predicates -------------------------------------------------


@query
def physics_features(spark, sf):
    return projections.add_physics(I.readings(spark, sf)).select("udi", *S.PHYSICS)


@query
def model_input(spark, sf):
    return projections.model_input(I.readings(spark, sf))


@query
def failure_label(spark, sf):
    return I.readings(spark, sf).select("udi", physics.failure_label().alias("failure_type"))


@query
def label_encode(spark, sf):
    return projections.encode_labels(I.training(spark, sf)).select("udi", "failure_type", "y")


@query
def label_decode(spark, sf):
    return projections.decode_labels(I.scored(spark, sf)).select("udi", "y", "label")


@query
def ordinal_encode(spark, sf):
    return projections.encode_grade(I.readings(spark, sf)).select("udi", "type", "type_code")


@query
def physics_rules(spark, sf):
    return projections.physics_rules(I.features(spark, sf))


@query
def wear_window(spark, sf):
    return projections.wear_window(I.readings(spark, sf)).select("udi", "tool_wear_min")


@query
def mode_count(spark, sf):
    return I.readings(spark, sf).select("udi", physics.mode_count().alias("n_modes"))


@query
def null_safe_distinct(spark, sf):
    target, staged = _upsert_sides(spark, sf)
    hole = F.when(~_every(9), F.col("air_temp_k"))
    return upsert.null_safe_distinct(
        target.withColumn("air_temp_k", hole), staged.withColumn("air_temp_k", hole), "udi"
    )


@query
def healthy_mask(spark, sf):
    return projections.healthy_and_flagged(I.tiered(spark, sf)).select("udi", "is_healthy")


@query
def flag_mask(spark, sf):
    return projections.healthy_and_flagged(I.tiered(spark, sf)).select("udi", "is_flagged")


# --- data quality ---------------------------------------------------------------


def _staged(spark, sf) -> DataFrame:
    return I.readings(spark, sf).withColumns({f: F.col(f).cast("int") for f in S.FLAGS})


def _dirty(spark, sf) -> DataFrame:
    batch = _staged(spark, sf).withColumns(
        {
            "air_temp_k": F.when(~_every(97), F.col("air_temp_k")),
            "type": F.when(_every(101), "X").otherwise(F.col("type")),
            "product_id": F.when(_every(89), "BAD").otherwise(F.col("product_id")),
            "twf": F.when(_every(83), 2).otherwise(F.col("twf")),
        }
    )
    return batch.unionByName(batch.where(_every(61)))


@query
def validate_batch(spark, sf):
    return quality.validate_batch(_dirty(spark, sf))


@query
def observed_rules(spark, sf):
    """The same counts, taken while the batch is written."""
    path = scratch_path(spark, "observed")
    batch, seen = quality.observed_batch(_dirty(spark, sf))
    batch.write.parquet(path)
    return quality.written_counts(seen, spark.read.schema(batch.schema).parquet(path))


@query
def flags_to_bool(spark, sf):
    return quality.flags_to_bool(_staged(spark, sf)).select("udi", *S.FLAGS)


def request_bodies(spark, sf) -> DataFrame:
    """(udi, body): every reading as JSON; fourteen ids in a hundred carry one fault."""
    good = F.to_json(F.struct(*[F.col(c) for c in S.RAW_INPUTS]))

    def put(field: str, text: str) -> Column:
        return F.regexp_replace(good, f'"{field}":[^,}}]+', f'"{field}":{text}')

    def put_value(field: str, value: Column) -> Column:
        return F.regexp_replace(
            good, F.lit(f'"{field}":[^,}}]+'), F.concat(F.lit(f'"{field}":'), value)
        )

    rpm = F.col("rotational_speed_rpm").cast("string")
    air = F.col("air_temp_k").cast("string")
    quote = F.lit('"')
    faults = [
        F.regexp_replace(good, r"\}$", ',"udi":1}'),
        F.regexp_replace(good, r"\}$", ',"action":"stop_machine"}'),
        F.regexp_replace(good, '"air_temp_k":[^,]+,', ""),
        put("type", '"X"'),
        put_value("rotational_speed_rpm", F.concat(quote, rpm, quote)),
        put_value("rotational_speed_rpm", F.concat(rpm, F.lit(".0"))),
        put("rotational_speed_rpm", "true"),
        put_value("air_temp_k", F.concat(quote, air, quote)),
        put("air_temp_k", "NaN"),
        put("air_temp_k", "Infinity"),
        put("air_temp_k", "0.0"),
        put("rotational_speed_rpm", "0"),
        put("torque_nm", "-1.0"),
        put("tool_wear_min", "-1"),
    ]
    body = F
    for case, fault in enumerate(faults, start=1):
        body = body.when(_every(100, case), fault)
    return I.readings(spark, sf).select("udi", body.otherwise(good).alias("body"))


def _violation_text() -> Column:
    return F.array_join(
        F.transform("violations", lambda v: F.concat(v["field"], F.lit(":"), v["type"])), ","
    )


@query
def validate_reading(spark, sf):
    checked = quality.validate_readings(request_bodies(spark, sf))
    return checked.select("udi", _violation_text().alias("violations"))


@query
def validate_typed(spark, sf):
    broken = I.readings(spark, sf).withColumns(
        {
            "air_temp_k": F.when(_every(31), float("nan")).otherwise(F.col("air_temp_k")),
            "torque_nm": F.when(_every(37), -1.0).otherwise(F.col("torque_nm")),
            "type": F.when(_every(41), "X").otherwise(F.col("type")),
        }
    )
    checked = quality.annotate(broken, quality.reading_checks())
    return checked.select("udi", F.array_join("violations", ",").alias("violations"))


def broken_log(spark, sf) -> DataFrame:
    """The log with twelve kinds of fault, chosen by id."""
    faults = {
        "model_version": (1, F.lit(0)),
        "type": (2, F.lit("X")),
        "air_temp_k": (3, F.lit(0.0)),
        "rotational_speed_rpm": (4, F.lit(0)),
        "torque_nm": (5, F.lit(-1.0)),
        "tool_wear_min": (6, F.lit(-1)),
        "p_twf": (7, F.lit(1.5)),
        "elevated_threshold": (9, F.lit(1.5)),
        "risk_tier": (11, F.when(F.col("risk_tier") == "low", "high").otherwise("low")),
        "confidence_score": (12, F.lit(None).cast("double")),
    }
    columns = {
        name: F.when(_every(16, case), bad).otherwise(F.col(name))
        for name, (case, bad) in faults.items()
    }
    columns["runner_up_mode"] = (
        F.when(_every(16, 8), "RNF")
        .when(_every(16, 10), F.col("predicted_mode"))
        .otherwise(F.col("runner_up_mode"))
    )
    return I.log(spark, sf).withColumns(columns)


@query
def check_constraints(spark, sf):
    checked = quality.annotate_log(broken_log(spark, sf))
    text = F.array_join(F.array_sort("violations"), ",")
    return checked.select("udi", text.alias("violations"))


@query
def constraint_counts(spark, sf):
    return quality.violation_counts(quality.annotate_log(broken_log(spark, sf)))


@query
def response_consistency(spark, sf):
    responses = risk.recommendations(I.log(spark, sf)).withColumn(
        "udi", F.conv(F.substring("request_id", 1, 4), 16, 10).cast("long")
    )
    broken = responses.withColumns(
        {
            "flagged": F.when(_every(7), ~F.col("flagged")).otherwise(F.col("flagged")),
            "risk_tier": F.when(_every(11), "high").otherwise(F.col("risk_tier")),
            "runner_up_mode": F.when(_every(13), F.col("predicted_mode")).otherwise(
                F.col("runner_up_mode")
            ),
            "confidence_score": F.col("confidence_score") + F.when(_every(17), 2).otherwise(0),
        }
    )
    checked = quality.annotate(broken, quality.response_checks())
    return checked.select("request_id", F.array_join("violations", ",").alias("violations"))


@query
def source_reconciliation(spark, sf):
    path = scratch_path(spark, "csv")
    readings = I.readings(spark, sf)
    csv_files.write_raw(readings, path)
    return reconcile.source_reconciliation(csv_files.read_batch(spark, path), readings)


# --- joins and set comparisons --------------------------------------------------


@query
def score_label_join(spark, sf):
    scored = I.scored(spark, sf)
    scores = scored.select("udi", classes.confidence("proba").alias("confidence_score"))
    return reconcile.score_label_join(scores, scored.select("udi", "failure_type"))


@query
def score_label_alignment(spark, sf):
    scored = I.scored(spark, sf)
    return reconcile.alignment(
        scored.where(~_every(50)).select("udi"), scored.where(~_every(70)).select("udi")
    )


@query
def error_to_reading(spark, sf):
    errors = evaluation.misclassified_rows(I.scored(spark, sf)).select("udi", "true", "predicted")
    return reconcile.errors_with_readings(errors, I.readings(spark, sf))


@query
def response_in_log(spark, sf):
    log = I.log(spark, sf)
    tier = F.when(_every(13), F.lit("unknown")).otherwise(F.col("risk_tier"))
    responses = log.withColumn("risk_tier", tier).select(
        "udi", "request_id", "risk_tier", "model_version", "elevated_threshold"
    )
    return reconcile.responses_not_logged(responses, log).select("udi", "request_id")


@query
def reproduction_check(spark, sf):
    scored = I.scored(spark, sf)
    relabelled = scored.withColumn("y", F.when(_every(40), 1).otherwise(F.col("y")))
    return reconcile.matrix_differences(
        evaluation.confusion_counts(relabelled), evaluation.confusion_counts(scored)
    )


@query
def parity_check(spark, sf):
    """The features in two computations, and with the product in another order."""
    readings = I.readings(spark, sf)
    view = projections.feature_view(readings).select("udi", *S.PHYSICS)
    served = projections.model_input(readings, "udi").select("udi", *S.PHYSICS)
    reordered = F.col("rotational_speed_rpm") * F.col("torque_nm") * (2 * F.pi() / 60)
    other = projections.add_physics(readings).withColumn("power_w", reordered)
    same = reconcile.multiset_difference(view, served)
    moved = reconcile.multiset_difference(view, other.select("udi", *S.PHYSICS))
    return same.withColumn("computation", F.lit("served")).unionByName(
        moved.withColumn("computation", F.lit("reordered"))
    )


def _sealed_pair(spark, sf) -> tuple[str, str]:
    """The readings, and the same with a 97th nudged, a 101st missing and a 103rd twice, sealed as trees."""
    readings = I.readings(spark, sf)
    nudged = readings.withColumn("torque_nm", F.when(_every(97), F.col("torque_nm") + 0.5).otherwise(F.col("torque_nm")))
    other = nudged.where(~_every(101)).unionByName(nudged.where(_every(103) & ~_every(101)))
    roots = scratch_path(spark, "sealed-left"), scratch_path(spark, "sealed-right")
    for rows, root in zip((readings, other), roots):
        table_diff.seal(rows, ["udi"], root, depth=3)
    return roots


@query
def table_diff_rows(spark, sf):
    """The rows in which two tables differ, from the buckets that differ."""
    return table_diff.differing_rows(spark, *_sealed_pair(spark, sf), ["udi"])


@query
def table_diff_nodes(spark, sf):
    """How many nodes of two trees were compared on each level, and how many differ."""
    levels, _ = table_diff.descend(spark, *_sealed_pair(spark, sf))
    return spark.createDataFrame(levels, "level int, n_compared long, n_differing long")


# --- aggregates -----------------------------------------------------------------


@query
def label_audit_modes(spark, sf):
    return audits.label_audit_modes(I.readings(spark, sf))


@query
def label_audit_multi(spark, sf):
    return audits.label_audit_multi(I.readings(spark, sf))


@query
def label_audit_contradictions(spark, sf):
    return audits.label_audit_contradictions(I.readings(spark, sf))


@query
def label_counts(spark, sf):
    return audits.label_counts(I.features(spark, sf))


@query
def spot_check(spark, sf):
    return audits.spot_check(I.features(spark, sf), 1)


@query
def rule_agreement(spark, sf):
    return audits.rule_agreement(I.features(spark, sf))


@query
def class_share(spark, sf):
    return audits.class_share(I.features(spark, sf))


@query
def class_profile(spark, sf):
    return audits.class_profile(I.features(spark, sf))


@query
def wear_window_counts(spark, sf):
    return audits.wear_window_counts(I.features(spark, sf))


@query
def type_by_class(spark, sf):
    return audits.type_by_class(I.features(spark, sf))


@query
def tier_counts(spark, sf):
    return audits.tier_counts(prediction_log.since_rows(I.log(spark, sf), CUTOFF))


@query
def tier_shares(spark, sf):
    shares = audits.tier_shares(prediction_log.since_rows(I.log(spark, sf), CUTOFF))
    return _rounded(shares, *shares.columns)


@query
def class_weights(spark, sf):
    return _rounded(audits.class_weights(I.training(spark, sf)), "weight")


# --- selection ------------------------------------------------------------------


@query
def kth_largest(spark, sf):
    """The room-th review score at three budgets."""
    scored = I.scored(spark, sf)
    choices = [risk.choose_threshold(scored, budget) for budget in (0.02, 0.05, 0.10)]
    rows = [(c.budget, c.room, c.threshold) for c in choices]
    return spark.createDataFrame(rows, "budget long, room long, kth double")


@query
def top_two(spark, sf):
    return evaluation.top_two(I.scored(spark, sf))


@query
def sample_head(spark, sf):
    """The first five training rows by id, the example stored with a model."""
    training = splits.train_rows(I.training(spark, sf))
    return training.select("udi", *S.FEATURES).orderBy("udi").limit(5)


# --- splits, weights and models -------------------------------------------------


@query
def stratified_split(spark, sf):
    split = splits.stratified_split(I.training(spark, sf))
    return split.select("udi", "failure_type", "split")


@query
def stratified_folds(spark, sf):
    training = splits.train_rows(I.training(spark, sf))
    return splits.stratified_folds(training).select("udi", "failure_type", "fold")


@query
def sample_weights(spark, sf):
    training = splits.train_rows(I.training(spark, sf))
    return _rounded(audits.sample_weights(training), "weight").select("udi", "weight")


FOREST = models.ModelSpec("forest", trees=20, depth=10, bins=64)
BOOSTED = models.ModelSpec("boosted", trees=3, depth=4, bins=64)


def _holdout(spark, sf) -> tuple[DataFrame, DataFrame]:
    labelled = I.training(spark, sf)
    assigned = splits.stratified_split(labelled)
    train = assigned.where(F.col("split") == "train").drop("split")
    return train, assigned.where(F.col("split") == "test").drop("split")


def _held_out_scores(spark, sf, spec) -> DataFrame:
    train, test = _holdout(spark, sf)
    model = models.fit_training_rows(train, spec)
    return models.score(model, projections.encode_labels(test))


@query
def forest_model(spark, sf):
    return evaluation.per_class_metrics(_held_out_scores(spark, sf, FOREST))


@query
def boosted_model(spark, sf):
    return evaluation.per_class_metrics(_held_out_scores(spark, sf, BOOSTED))


@query
def boosted_rounds(spark, sf):
    """What holds of every round on the training rows: the loss falls, and every leaf is a Newton step of its class."""
    train, _ = _holdout(spark, sf)
    prepared = materialise(models.prepare(train).select("udi", *S.FEATURES, "features", "type_code", "y", "weight", "label"))
    rows = models.staged(models.fit(prepared, BOOSTED), prepared.select("udi", *S.FEATURES, "y", "weight"))
    scored = materialise(rows.select("udi", "y", "weight", "margins"))
    each = scored.select("y", "weight", F.posexplode("margins").alias("round", "margin"))
    loss = F.sum(F.col("weight") * models.log_loss(models.softmax(F.col("margin")), F.col("y"))) / F.sum("weight")
    losses = each.groupBy("round").agg(F.count("*").alias("n_rows"), F.sum("weight").alias("total_weight"), loss.alias("loss"))
    n = len(S.CLASSES)
    moved = scored.select("y", "weight", F.explode(F.sequence(F.lit(1), F.lit(BOOSTED.trees))).alias("round"), "margins").select(
        "y", "weight", "round", F.element_at("margins", F.col("round")).alias("margin"),
        F.zip_with(F.element_at("margins", F.col("round") + 1), F.element_at("margins", F.col("round")), lambda a, b: F.round(a - b, 9)).alias("step"),
    )
    leaves = models.gradients(moved).select(
        "round", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(n - 1)).alias("k"), F.col("step"), F.col("g"), F.col("h"))).alias("x")
    ).groupBy("round", "x.k", "x.step").agg(F.sum("x.g").alias("g"), F.sum("x.h").alias("h"))
    newton = F.abs(F.col("step") + BOOSTED.learning_rate * F.col("g") / (F.col("h") + BOOSTED.l2)) < 1e-6
    # leaves that took the same step would be summed together; they are told by their penalty being counted twice
    several = F.abs(F.col("step") * (F.col("h") + 2 * BOOSTED.l2) + BOOSTED.learning_rate * F.col("g")) < 1e-6
    steps = leaves.groupBy("round").agg(F.every(newton | several).alias("newton_leaves"))
    before = Window.partitionBy().orderBy("round")  # one row per round
    return losses.withColumn("fell", F.coalesce(F.col("loss") < F.lag("loss").over(before), F.abs(F.col("loss") - F.log(F.lit(float(n)))) < 1e-9)).join(
        steps, "round", "left"
    ).select("round", "n_rows", F.round("total_weight", 3).alias("total_weight"), "fell", F.coalesce("newton_leaves", F.lit(True)).alias("newton_leaves"))


@query
def forest_splits(spark, sf):
    """A tree's root and second level against the gain of every threshold there is."""
    train, _ = _holdout(spark, sf)
    prepared = materialise(models.dealt(models.prepare(train)))
    model = models.fit(prepared, models.ModelSpec("forest", trees=1, depth=2, bins=256, bootstrap=False))
    found = split_audit.audit(prepared, split_audit.splits_of(model.stages[-1], prepared))
    return found.groupBy("level").agg(
        F.count("*").alias("n_nodes"), F.sum("n_rows").alias("n_rows"),
        F.every(F.abs(F.col("gain") - F.col("stored_gain")) < 1e-6).alias("gains_match"),
        F.every(F.col("gain") >= 0.98 * F.col("best_gain")).alias("near_best"),
    )


@query
def batch_score(spark, sf):
    scored = _held_out_scores(spark, sf, FOREST)
    return scored.select(
        "udi", *[F.element_at("proba", k + 1).alias(c) for k, c in enumerate(S.PROBA_COLUMNS)]
    )


@query
def oof_proba(spark, sf):
    """Every fold's model reads one table of bins, written once."""
    training = splits.train_rows(I.training(spark, sf))
    folded = splits.fold_cuts(training).assign(training, "fold").withColumn("fold", F.col("fold").cast("int"))
    shared, _ = models.shared_table(folded, FOREST, ("udi", "fold"))
    scored = materialise(models.out_of_fold(shared, FOREST).select("udi", "y", "fold", "proba"))
    total = F.aggregate("proba", F.lit(0.0), lambda a, b: a + b)
    return scored.select(
        "udi", "y", "fold",
        F.size("proba").alias("n_classes"),
        F.forall("proba", lambda p: p.between(0, 1)).alias("in_range"),
        (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
    )


@query
def shared_bins(spark, sf):
    """What each bin of the training rows holds, as all fits share them."""
    training = splits.train_rows(I.training(spark, sf))
    bins = binning.bin_edges(training, FOREST.bins)
    coded = bins.stage().transform(training)
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(b).cast("int").alias("bin"), F.col(c).cast("double").alias("value"))
        for c, b in zip(bins.edges, bins.columns)
    ])
    return coded.select(F.explode(pairs).alias("x")).groupBy("x.column", "x.bin").agg(
        F.count("*").alias("n_rows"), F.min("x.value").alias("lowest"), F.max("x.value").alias("highest")
    )


def _learned_grade(spark, sf, spec) -> DataFrame:
    """Test rows with the grade that a model names after it was taught the grade as its class."""
    train, test = _holdout(spark, sf)
    taught = F.when(F.col("type") == "L", S.CLASSES[0]).when(F.col("type") == "M", S.CLASSES[1])
    model = models.fit_training_rows(train.withColumn("failure_type", taught.otherwise(S.CLASSES[2])), spec)
    code = classes.top_code("proba")
    return models.score(model, test).select("udi", code.cast("int").alias("grade_code"))


@query
def separable_forest(spark, sf):
    return _learned_grade(spark, sf, FOREST)


@query
def separable_boosted(spark, sf):
    return _learned_grade(spark, sf, BOOSTED)


@query
def unseen_folds(spark, sf):
    """Each fold is taught as a class of its own, so only a model that saw a row's fold gives it a share."""
    folded = splits.stratified_folds(splits.train_rows(I.training(spark, sf)))
    own = F.element_at(F.array(*[F.lit(c) for c in S.CLASSES]), F.col("fold") + 1)
    prepared = models.prepare(folded.withColumn("failure_type", own)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        scored = materialise(models.out_of_fold(prepared, FOREST).select("udi", "fold", "proba"))
    finally:
        prepared.unpersist()
    return scored.select("udi", "fold", F.element_at("proba", F.col("fold") + 1).alias("own_share"))


@query
def model_save_load(spark, sf):
    """Scores of the saved and reloaded model, behind its signature, next to those before saving."""
    train, test = _holdout(spark, sf)
    model = models.fit_training_rows(train, FOREST)
    root = scratch_path(spark, "model")
    bundles.save_model(model, root, bundles.Signature.of(train.select(*S.FEATURES), models.score(model, train.select(*S.FEATURES))))
    before = models.score(model, test).select("udi", F.col("proba").alias("before"))
    after = bundles.load_scorer(spark, root)(test).select("udi", F.col("proba").alias("after"))
    return before.join(after, "udi").select("udi", (F.col("before") == F.col("after")).alias("same"))


def _folded_scores(spark, sf) -> DataFrame:
    return splits.stratified_folds(I.scored(spark, sf))


@query
def cv_scores(spark, sf):
    cv = evaluation.cv_scores(_folded_scores(spark, sf))
    return _rounded(cv, *cv.columns)


@query
def scope_scores(spark, sf):
    """Per-class scores of each fold and of all rows, from one scan."""
    scores = evaluation.scope_scores(_folded_scores(spark, sf)).drop("class_pos")
    return _rounded(scores, "precision", "recall", "f1")


# --- evaluation -----------------------------------------------------------------


@query
def predict_class(spark, sf):
    return evaluation.predicted(I.scored(spark, sf)).select("udi", "pred")


@query
def per_class_metrics(spark, sf):
    return _rounded(
        evaluation.per_class_metrics(I.scored(spark, sf)), "precision", "recall", "f1", "roc_auc"
    )


@query
def ovr_auc(spark, sf):
    return _rounded(evaluation.ovr_auc(I.scored(spark, sf)), "roc_auc")


@query
def fold_std(spark, sf):
    return _rounded(
        evaluation.fold_std(_folded_scores(spark, sf)), "precision", "recall", "f1", "roc_auc"
    )


@query
def confusion_counts(spark, sf):
    return evaluation.confusion_counts(I.scored(spark, sf))


@query
def confusion_normalised(spark, sf):
    return _rounded(evaluation.confusion_normalised(I.scored(spark, sf)), "share")


@query
def false_alarms(spark, sf):
    return evaluation.false_alarms(I.scored(spark, sf))


@query
def metric_long(spark, sf):
    table = evaluation.per_class_metrics(I.scored(spark, sf))
    return _rounded(evaluation.metric_long(table, "oof"), "value")


@query
def misclassified_rows(spark, sf):
    return evaluation.misclassified_rows(I.scored(spark, sf))


@query
def summary_scores(spark, sf):
    summary = evaluation.summary_scores(I.scored(spark, sf))
    return _rounded(summary, *summary.columns)


@query
def macro_auc(spark, sf):
    macro = evaluation.macro_auc(I.scored(spark, sf))
    return _rounded(macro, *macro.columns)


@query
def runner_up_hit_rate(spark, sf):
    return _rounded(evaluation.runner_up_hit_rate(I.scored(spark, sf)), "hit_rate")


@query
def error_margin(spark, sf):
    errors = evaluation.misclassified_rows(I.scored(spark, sf)).select("udi", "true", "predicted")
    return evaluation.error_margin(errors, I.features(spark, sf))


# --- risk tiers -----------------------------------------------------------------


@query
def confidence_score(spark, sf):
    return risk.confidence_scores(I.scored(spark, sf))


@query
def assign_tiers(spark, sf):
    return I.tiered(spark, sf).select("udi", "risk_tier")


@query
def choose_threshold(spark, sf):
    choice = risk.choose_threshold(I.scored(spark, sf), BUDGET)
    row = (choice.budget, choice.n_healthy, choice.n_healthy_high, choice.room, choice.threshold)
    return spark.createDataFrame(
        [row], "budget long, n_healthy long, n_healthy_high long, room long, threshold double"
    )


def _budget_tiers(spark, sf) -> DataFrame:
    scored = I.scored(spark, sf)
    return risk.assign_tiers(scored, risk.choose_threshold(scored, BUDGET).threshold)


@query
def tier_report(spark, sf):
    return risk.tier_report(_budget_tiers(spark, sf))


@query
def tier_hit_rate(spark, sf):
    return _rounded(risk.tier_hit_rate(_budget_tiers(spark, sf)), "hit_rate")


@query
def flag_counts(spark, sf):
    return risk.flag_counts(_budget_tiers(spark, sf))


@query
def recommend(spark, sf):
    answers = risk.recommendations(I.log(spark, sf))
    flat = [c for c in answers.columns if c not in ("class_probabilities", "physics_features")]
    return answers.select(*flat, "class_probabilities.*", "physics_features.*").withColumn(
        "created_at", _time_text()
    )


# --- drift and workload ---------------------------------------------------------


def _current_log(spark, sf, fault: float = 0.0) -> DataFrame:
    """Logged requests since the cutoff; with a fault, what the sensor would have said."""
    rows = prediction_log.since_rows(I.log(spark, sf), CUTOFF)
    if fault:
        rows = projections.add_physics(rows.withColumn("air_temp_k", F.col("air_temp_k") + fault))
    return rows.select(*S.FEATURES, "risk_tier", "predicted_mode")


def _both_windows(spark, sf, build) -> DataFrame:
    reference = I.reference_window(spark, sf)
    parts = [
        build(reference, I.current_window(spark, sf, fault)).withColumn("scenario", F.lit(name))
        for name, fault in (("healthy", 0.0), ("fault", FAULT_K))
    ]
    return parts[0].unionByName(parts[1])


@query
def wasserstein_drift(spark, sf):
    return _rounded(_both_windows(spark, sf, drift.wasserstein_drift), "score")


@query
def js_drift(spark, sf):
    return _rounded(_both_windows(spark, sf, drift.js_drift), "score")


@query
def column_verdicts(spark, sf):
    return _rounded(_both_windows(spark, sf, drift.drift_verdicts), "score")


@query
def profile_verdicts(spark, sf):
    """The same verdicts from a stored profile of the reference."""
    path = scratch_path(spark, "profile")
    drift.reference_profile(I.reference_window(spark, sf)).write.parquet(path)
    profile = spark.read.parquet(path)
    parts = [
        drift.profile_verdicts(profile, I.current_window(spark, sf, fault)).withColumn(
            "scenario", F.lit(name)
        )
        for name, fault in (("healthy", 0.0), ("fault", FAULT_K))
    ]
    return _rounded(parts[0].unionByName(parts[1]), "score")


@query
def dataset_verdict(spark, sf):
    def build(reference, current):
        return drift.dataset_verdict(drift.drift_verdicts(reference, current))

    return _both_windows(spark, sf, build)


@query
def insufficient_data(spark, sf):
    """The row gate on the current window and on one day of the log."""
    day = prediction_log.since_rows(I.log(spark, sf), CUTOFF).where(
        F.col("log_date") == F.lit(CUTOFF.date())
    )
    whole = drift.data_gate(I.log(spark, sf)).withColumn("rows_of", F.lit("log"))
    return whole.unionByName(drift.data_gate(day).withColumn("rows_of", F.lit("day")))


@query
def workload_vs_expected(spark, sf):
    load = drift.workload_vs_expected(prediction_log.since_rows(I.log(spark, sf), CUTOFF))
    return _rounded(load, *load.columns)


@query
def drift_window(spark, sf):
    reference = materialise(drift.reference_profile(reference_scan(spark, sf)))
    rows = []
    for name, fault in (("healthy", 0.0), ("fault", FAULT_K)):
        window, _ = drift.drift_window(
            reference, _current_log(spark, sf, fault), CUTOFF.isoformat()
        )
        rows.append(window.withColumn("scenario", F.lit(name)))
    return _rounded(
        rows[0].unionByName(rows[1]),
        "share_low", "share_elevated", "share_high", "share_flagged", "flagged_vs_expected",
    )


@query
def day_profile_verdicts(spark, sf):
    """The verdicts of the window since the cutoff, from profiles of its days and no log row."""
    root, last = scratch_path(spark, "days"), datetime.date(9999, 12, 31)
    day_profiles.write_days(I.log(spark, sf), root)
    reference = materialise(drift.reference_profile(reference_scan(spark, sf)))
    days = day_profiles.read_days(spark, root, CUTOFF.date(), last)
    load = day_profiles.window_load(days).first().asDict()
    verdicts = day_profiles.window_verdicts(reference, days)
    return _rounded(verdicts.withColumns({name: F.lit(n).cast("long") for name, n in load.items()}), "score")


@query
def false_alarm_rate(spark, sf):
    """Every published size; one that the pool can't fill has no window and no rate."""
    return drift.false_alarm_rate(I.reference_window(spark, sf), I.current_window(spark, sf), WINDOW_SIZES, WINDOWS_PER_SIZE)


@query
def mode_counts(spark, sf):
    return audits.mode_counts(prediction_log.since_rows(I.log(spark, sf), CUTOFF))


# --- integrity ------------------------------------------------------------------


@query
def fingerprint(spark, sf):
    """The test rows as they are, in another order, and with one value 1 ulp off."""
    _, test = _holdout(spark, sf)
    columns = integrity.sealed_columns()
    nudge = F.when(F.col("udi") == F.lit(test.agg(F.min("udi")).first()[0]), 2.0**-44).otherwise(0.0)
    variants = {
        "as_is": test,
        "shuffled": test.repartition(7, F.rand(1)),
        "nudged": test.withColumn("air_temp_k", F.col("air_temp_k") + nudge),
    }
    base = integrity.fingerprint_hex(test, *columns)
    parts = [
        integrity.fingerprint(rows, *columns).select(
            F.lit(name).alias("variant"), "n_rows", (F.col("fingerprint") == base).alias("matches")
        )
        for name, rows in variants.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- streaming ------------------------------------------------------------------


def rule_scorer(inputs: DataFrame) -> DataFrame:
    """Fixed probabilities from the physics rules: a served model without a fit."""
    weights = F.array(
        F.lit(1.0),
        F.when(physics.in_wear_window(), 0.6).otherwise(0.01),
        F.when(physics.heat_rule(), 2.0).otherwise(0.02),
        F.when(physics.power_rule(), 3.0).otherwise(0.03),
        F.when(physics.strain_rule(), 2.5).otherwise(0.05),
    )
    total = F.aggregate("_w", F.lit(0.0), lambda a, b: a + b)
    kept = inputs.columns
    return inputs.withColumn("_w", weights).select(
        *kept, F.transform("_w", lambda w: w / total).alias("proba")
    )


def _run_stream(spark, sf) -> scoring.StreamPaths:
    """All requests through the scoring stream, in as many batches as there are files."""
    root = scratch_path(spark, "stream")
    request_bodies(spark, sf).select("body").write.text(f"{root}/requests")
    served = scoring.Served(rule_scorer, 0.3, I.MODEL_NAME, I.MODEL_VERSION)
    paths = scoring.StreamPaths(f"{root}/out")
    requests = scoring.read_requests(spark, f"{root}/requests", files_per_batch=4)
    scoring.start(requests, served, paths).awaitTermination()
    return paths


@query
def stream_once(spark, sf):
    """Requests of which every third is sent again in a later batch, after a restart: each is scored once."""
    root = scratch_path(spark, "stream-once")
    sent = I.log(spark, sf).select(F.col("request_id").alias("request_key"), F.col("created_at").alias("sent_at"), F.to_json(F.struct(*[c for c in S.FEATURES if c not in S.PHYSICS])).alias("body"), "udi")
    paths = scoring.StreamPaths(f"{root}/out")
    served = scoring.Served(rule_scorer, 0.3, I.MODEL_NAME, I.MODEL_VERSION)
    for part in (sent, sent.where(_every(3))):
        part.drop("udi").write.mode("append").json(f"{root}/requests")
        requests = scoring.read_keyed_requests(spark, f"{root}/requests")
        scoring.start(scoring.scored_once(requests, "400 days"), served, paths).awaitTermination()
    counts = {"n_sent": spark.read.json(f"{root}/requests", "body string"), "n_logged": prediction_log.read_log(spark, paths.log), "n_published": spark.read.parquet(paths.published)}
    return spark.createDataFrame([tuple(rows.count() for rows in counts.values())], ", ".join(f"{name} long" for name in counts))


@query
def stream_late_rows(spark, sf):
    """A tenth of the log arrives last: per day the rows sent, counted and late, and whether the day is still open.

    Every row sent is in a closed window, in an open one, or late.
    """
    root = scratch_path(spark, "stream-late")
    log = I.log(spark, sf).select("udi", "created_at", "risk_tier")
    paths = workload.WorkloadPaths(f"{root}/out")
    early = F.col("created_at") < CUTOFF
    for part in (~_every(10) & early, ~_every(10) & ~early, _every(10)):
        log.where(part).write.mode("append").parquet(f"{root}/log")
        rows = spark.readStream.schema(log.schema).parquet(f"{root}/log")
        workload.start(rows, paths).awaitTermination()
    windows = workload.read_windows(spark, paths).select("window_start", "n_rows", "n_elevated", "n_high", "is_open")
    late = workload.read_late(spark, paths, log.schema)

    def per_day(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(F.date_trunc("day", "created_at").alias("window_start")).agg(F.count("*").alias(name))

    sent = per_day(spark.read.schema(log.schema).parquet(f"{root}/log"), "n_sent")
    joined = sent.join(windows, "window_start", "full").join(per_day(late, "n_late"), "window_start", "full")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_sent", "n_rows", "n_late", "n_elevated", "n_high")]
    return joined.select(_time_text("window_start"), *counts, F.coalesce("is_open", F.lit(False)).alias("is_open"))


@query
def stream_score(spark, sf):
    published = spark.read.parquet(_run_stream(spark, sf).published)
    return published.groupBy("risk_tier", "predicted_mode", "runner_up_mode").agg(
        F.count("*").alias("n_rows"),
        F.round(F.avg("confidence_score"), ROUNDING).alias("avg_confidence"),
    )


@query
def stream_quarantine(spark, sf):
    rejected = spark.read.parquet(_run_stream(spark, sf).quarantine)
    return rejected.groupBy(_violation_text().alias("violations")).agg(
        F.count("*").alias("n_rows")
    )


@query
def stream_log(spark, sf):
    """Every published id is in the log with the same tier, version and threshold."""
    paths = _run_stream(spark, sf)
    log = prediction_log.read_log(spark, paths.log)
    published = spark.read.parquet(paths.published).join(
        log.select("request_id", "elevated_threshold"), "request_id", "left"
    )
    missing = reconcile.responses_not_logged(published, log).select(F.lit("missing").alias("what"))
    what = (
        log.select(F.lit("logged").alias("what"))
        .unionByName(published.select(F.lit("published").alias("what")))
        .unionByName(missing)
    )
    return what.agg(
        *[F.count_if(F.col("what") == w).alias(f"n_{w}") for w in ("logged", "published", "missing")]
    )


@query
def stream_workload(spark, sf):
    """Tier counts per day of the log read as a stream; the last windows stay open."""
    source = scratch_path(spark, "stream-log")
    log = I.log(spark, sf).select("created_at", "risk_tier")
    log.write.parquet(source)
    rows = spark.readStream.schema(log.schema).parquet(source)
    out = scratch_path(spark, "stream-workload")
    stream = scoring.stream_workload(rows).writeStream.outputMode("append")
    stream = stream.option("checkpointLocation", f"{out}/checkpoint").option("path", f"{out}/rows")
    stream.format("parquet").trigger(availableNow=True).start().awaitTermination()
    result = spark.read.parquet(f"{out}/rows")
    return result.select(
        _time_text("window_start"), "n_rows", "n_elevated", "n_high",
        F.round("share_flagged", ROUNDING).alias("share_flagged"),
    )
