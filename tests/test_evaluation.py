import pytest
from pyspark.sql import functions as F

import toys
from millwatch import schema as S
from millwatch.operators import evaluation, selection


@pytest.fixture(scope="module")
def scored(spark):
    return toys.scored(spark, toys.METRICS_Y, [toys.one_hot(p) for p in toys.METRICS_PRED])


def column(df, name):
    return [r[name] for r in df.collect()]


def by_class(df):
    return {r["class"]: r.asDict() for r in df.collect()}


def test_each_class_by_hand(scored):
    found = by_class(evaluation.per_class_metrics(scored))
    assert list(found) == list(S.CLASSES)
    wanted = {  # precision, recall, f1, roc_auc, support
        "no_failure": (4 / 5, 4 / 5, 4 / 5, (4 / 5 + 6 / 7) / 2, 5),
        "TWF": (1, 1 / 2, 2 / 3, 3 / 4, 2),
        "HDF": (2 / 3, 1, 4 / 5, 19 / 20, 2),
        "PWF": (1 / 2, 1, 2 / 3, 21 / 22, 1),
        "OSF": (1, 1 / 2, 2 / 3, 3 / 4, 2),
    }
    for name, values in wanted.items():
        row = found[name]
        assert [row[c] for c in ("precision", "recall", "f1", "roc_auc", "support")] == pytest.approx(values)


def test_auc_is_the_same_when_values_are_cut_into_ranges(scored):
    whole = column(evaluation.ovr_auc(scored), "roc_auc")
    assert column(evaluation.ovr_auc(scored, plain_rows=0), "roc_auc") == pytest.approx(whole)


def test_auc_of_graded_scores_counts_pairs_and_halves_ties(spark):
    """Against all pairs: ties, a one-sided class, and a class the truth lacks."""
    score = [0.1, 0.4, 0.4, 0.4, 0.7, 0.9, 0.4, 0.1]
    y = [0, 0, 1, 0, 1, 1, 1, 0]
    table = by_class(evaluation.ovr_auc(toys.scored(spark, y, [[1 - s, s, 0.0, 0.0, 0.0] for s in score])))
    pairs = [(a > b) + (a == b) / 2 for a, i in zip(score, y) if i for b, j in zip(score, y) if not j]
    assert table["TWF"]["roc_auc"] == pytest.approx(sum(pairs) / len(pairs))
    assert table["no_failure"]["roc_auc"] == pytest.approx(sum(pairs) / len(pairs))
    assert table["OSF"]["roc_auc"] is None
    alone = by_class(evaluation.ovr_auc(toys.scored(spark, [1] * 3, [toys.one_hot(1)] * 3)))
    assert alone["TWF"]["roc_auc"] is None


def test_cells_hold_the_misses_and_nothing_else(scored):
    cells = {(r["true"], r["predicted"]): r["n_rows"] for r in evaluation.confusion_counts(scored).collect()}
    assert len(cells) == 25
    assert {k: n for k, n in cells.items() if n and k[0] != k[1]} == {
        ("no_failure", "HDF"): 1, ("TWF", "PWF"): 1, ("OSF", "no_failure"): 1,
    }
    assert [cells[c, c] for c in S.CLASSES] == [4, 1, 2, 1, 1]
    assert evaluation.false_alarms(scored).first()[0] == 1


def test_shares_of_a_row_sum_to_one_or_are_all_zero(spark):
    some = toys.scored(spark, [4, 4, 4, 2], [toys.one_hot(k) for k in (4, 0, 1, 2)])
    shares = {}
    for r in evaluation.confusion_normalised(some).collect():
        shares.setdefault(r["true"], []).append(r["share"])
    assert sum(shares["OSF"]) == pytest.approx(1) and max(shares["OSF"]) == pytest.approx(1 / 3)
    assert sum(shares["HDF"]) == 1 and not any(sum(shares[c]) for c in ("no_failure", "TWF", "PWF"))


def test_long_names_carry_prefix_class_and_suffix(scored):
    table = evaluation.per_class_metrics(scored)
    long = {r["metric"]: r["value"] for r in evaluation.metric_long(table, "eval", "_x").collect()}
    assert set(long) == {f"eval_{m}_{c}_x" for m in ("precision", "recall", "f1", "roc_auc") for c in S.CLASSES}
    assert long["eval_precision_HDF_x"] == pytest.approx(2 / 3)


def test_spread_over_folds_divides_by_their_number(spark):
    """Three folds; HDF is found in the first two only, and the healthy row always."""
    y, pred = [0, 2, 3], {0: [0, 2, 3], 1: [0, 2, 3], 2: [0, 3, 3]}
    rows = [(10 * f + i, y[i], toys.one_hot(pred[f][i]), f) for f in pred for i in range(3)]
    df = spark.createDataFrame(rows, toys.SCORED + ", fold int")
    table = by_class(evaluation.fold_std(df))
    assert table["HDF"]["recall"] == pytest.approx((2 / 9) ** 0.5)
    assert table["no_failure"]["recall"] == 0
    cv = evaluation.cv_scores(df).first()
    assert cv["cv_balanced_accuracy_mean"] == pytest.approx(8 / 9)
    assert cv["cv_balanced_accuracy_std"] == pytest.approx((2 / 9) ** 0.5 / 3)


def test_errors_name_both_guesses(spark):
    """Wrong rows put 0.5 on the guess and 0.3 on the truth; one puts the truth third."""
    proba = []
    for i, (y, p) in enumerate(zip(toys.METRICS_Y, toys.METRICS_PRED)):
        row = [0.05] * 5
        row[p], row[y if y != p else (p + 2) % 5] = 0.5, 0.3
        if i == 6:
            row[0], row[y] = 0.3, 0.1
        proba.append(row)
    rows = {r["udi"]: r for r in evaluation.misclassified_rows(toys.scored(spark, toys.METRICS_Y, proba)).collect()}
    named = {k: (r["true"], r["predicted"], r["runner_up"]) for k, r in rows.items()}
    assert named == {
        105: ("no_failure", "HDF", "no_failure"), 107: ("TWF", "PWF", "no_failure"), 112: ("OSF", "no_failure", "OSF"),
    }
    assert {k: r["p_true"] for k, r in rows.items()} == {105: 0.3, 107: 0.1, 112: 0.3}
    assert all((r["p_predicted"], r["p_runner_up"]) == (0.5, 0.3) for r in rows.values())
    hits = evaluation.runner_up_hit_rate(toys.scored(spark, toys.METRICS_Y, proba)).first()
    assert tuple(hits) == (2, 1, 0.5)


def test_undefined_auc_is_null_and_the_two_means_differ(spark):
    some = toys.scored(spark, [0, 0, 1], [toys.one_hot(k) for k in (0, 1, 1)])
    auc = column(evaluation.ovr_auc(some), "roc_auc")
    assert auc[2:] == [None, None, None]
    macro = evaluation.macro_auc(some).first()
    assert macro["roc_auc_macro_strict"] is None
    assert macro["roc_auc_macro_defined"] == pytest.approx(sum(auc[:2]) / 2)


def test_summary_uses_all_classes_or_those_seen(spark):
    some = toys.scored(spark, [0, 0, 1], [toys.one_hot(k) for k in (0, 0, 1)])
    row = evaluation.summary_scores(some).first()
    assert tuple(row) == pytest.approx((2 / 5, 1.0, 1.0))


def test_missing_class_column_is_rejected(spark):
    bad = spark.createDataFrame([(1, 0, [0.5, 0.5, 0.0, 0.0])], toys.SCORED)
    with pytest.raises(Exception, match="needs one probability for each of 5"):
        evaluation.confusion_counts(bad).collect()


def test_scopes_are_each_fold_and_all_rows_from_one_scan(spark):
    rows = toys.scored(spark, toys.METRICS_Y, [toys.one_hot(k) for k in toys.METRICS_PRED])
    fold = F.when(F.col("udi") % 3 < 2, F.col("udi") % 3)
    folded = rows.withColumn("fold", fold.cast("int"))
    found = evaluation.scope_scores(folded)
    keep = ["class", "precision", "recall", "f1", "support"]
    parts = {"all": folded, "none": folded.where("fold is null"), "0": folded.where("fold = 0"), "1": folded.where("fold = 1")}
    assert {r["scope"] for r in found.select("scope").collect()} == set(parts)
    for scope, part in parts.items():
        expected = sorted(tuple(r) for r in evaluation.per_class_metrics(part).select(keep).collect())
        assert sorted(tuple(r) for r in found.where(F.col("scope") == scope).select(keep).collect()) == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("Scan ExistingRDD") == 1


def test_distinct_scores_are_dealt_by_their_number(spark, monkeypatch):
    """No task holds more scores than the ranges allow, and a score that most rows share is summed up before it is sent."""
    monkeypatch.setattr(selection, "RANGE_ROWS", 100)
    proba = F.array(F.col("id") / 2000, 1 - F.col("id") / 2000, F.lit(0.0), F.lit(0.0), F.lit(0.0))
    scored = spark.range(2000).select("id", (F.col("id") % 5).cast("int").alias("y"), proba.alias("proba"))
    given, plain = [], column(evaluation.ovr_auc(scored), "roc_auc")
    sums = evaluation.running_sums
    monkeypatch.setattr(evaluation, "running_sums", lambda counts, *a, **b: given.append(counts) or sums(counts, *a, **b))
    assert column(evaluation.ovr_auc(scored, plain_rows=0), "roc_auc") == pytest.approx(plain)
    sizes = [r["count"] for r in given[0].groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(sizes) == 4003 and len(sizes) > 64 and max(sizes) <= 200
    assert given[0].where("score = 0").agg(F.sum(F.col("pos") + F.col("neg"))).first()[0] == 6001
