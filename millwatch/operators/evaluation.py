"""Classifier evaluation from scored rows.

Scored rows carry an id, the true code `y` and the probability array `proba`.
Everything but the AUC follows from one confusion aggregate of at most 25 rows
(times folds); the AUC aggregates distinct scores per class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch import schema as S
from millwatch.functions import classes, physics
from millwatch.operators.selection import (
    RANK_ROWS,
    ranges_for,
    running_sums,
)
from millwatch.session import dimension

_SCORES = ("precision", "recall", "f1", "roc_auc")


def predicted(scored: DataFrame, proba: str = "proba") -> DataFrame:
    """Adds `pred` and `runner_up` codes."""
    with_top = scored.withColumn("pred", classes.top_code(classes.checked_proba(proba)))
    return with_top.withColumn("runner_up", classes.runner_up_code(proba, "pred"))


def top_two(scored: DataFrame, id_column: str = "udi") -> DataFrame:
    """Names of the most and second most probable class per row."""
    return predicted(scored).select(
        id_column,
        classes.class_name("pred").alias("predicted"),
        classes.class_name("runner_up").alias("runner_up"),
    )


def _confusion(scored: DataFrame, *by: str) -> DataFrame:
    """Counts of the (y, pred) pairs that occur, per `by`."""
    pairs = scored.select(*by, "y", classes.top_code(classes.checked_proba("proba")).alias("pred"))
    return pairs.groupBy(*by, "y", "pred").agg(F.count("*").alias("n"))


def confusion_counts(scored: DataFrame) -> DataFrame:
    """All true x predicted cells in class order, zeros included."""
    cells = dimension(scored.sparkSession, true=S.CLASSES, predicted=S.CLASSES)
    found = _confusion(scored).withColumnsRenamed({"y": "true_pos", "pred": "predicted_pos"})
    return (
        cells.join(found, ["true_pos", "predicted_pos"], "left")
        .orderBy("true_pos", "predicted_pos")
        .select("true", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"))
    )


def confusion_normalised(scored: DataFrame) -> DataFrame:
    return normalised_of(confusion_counts(scored))


def normalised_of(cells: DataFrame) -> DataFrame:
    """Cells as a share of their true class; a class without rows gives 0."""
    totals = cells.groupBy("true").agg(F.sum("n_rows").alias("total"))
    share = F.coalesce(F.col("n_rows") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    return cells.join(F.broadcast(totals), "true").select("true", "predicted", share.alias("share"))


def _pairs_of(cells: DataFrame) -> DataFrame:
    return cells.select(
        classes.class_code("true").alias("y"),
        classes.class_code("predicted").alias("pred"),
        F.col("n_rows").alias("n"),
    )


def _ratio(numerator, denominator):
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def _class_scores(confusion: DataFrame, *by: str) -> DataFrame:
    """precision, recall, f1, support per class listed, from confusion counts."""
    per_class = confusion.groupBy(*by).agg(
        *[
            expr.alias(f"{name}_{k}")
            for k in range(len(S.CLASSES))
            for name, expr in {
                "tp": F.sum(F.when((F.col("y") == k) & (F.col("pred") == k), F.col("n")).otherwise(0)),
                "support": F.sum(F.when(F.col("y") == k, F.col("n")).otherwise(0)),
                "called": F.sum(F.when(F.col("pred") == k, F.col("n")).otherwise(0)),
            }.items()
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("class_pos"),
                F.lit(name).alias("class"),
                *[F.coalesce(f"{c}_{k}", F.lit(0)).alias(c) for c in ("tp", "support", "called")],
            )
            for k, name in enumerate(S.CLASSES)
        ]
    )
    counts = per_class.select(*by, F.inline(rows))
    tp, support, called = F.col("tp"), F.col("support"), F.col("called")
    return counts.select(
        *by,
        "class_pos",
        "class",
        _ratio(tp, called).alias("precision"),
        _ratio(tp, support).alias("recall"),
        _ratio(2 * tp, support + called).alias("f1"),
        support.cast("long").alias("support"),
        called.cast("long").alias("called"),
    )


def _score_profiles(scored: DataFrame, *by: str) -> dict[int, dict]:
    """Row count of each class's scores per `by`: as many distinct scores at most."""
    counted = scored.groupBy(*by).agg(F.count("*").alias("n")).collect()
    return {
        (row[by[0]] if by else 0) * len(S.CLASSES) + k: {"distinct": row["n"]}
        for row in counted
        for k in range(len(S.CLASSES))
    }


def _score_counts(scored: DataFrame, profiles: dict[int, dict], plain_rows: int, *by: str) -> DataFrame:
    """Hits and misses of every distinct score, per group of `by` and class.

    Beyond `plain_rows` rows, tasks are dealt by the number of scores, as almost
    every score may be distinct. The rows are first dealt evenly and summed up in
    their task, so that a score shared by many rows comes to its task as one row
    of each of those.
    """
    group = F.col(by[0]) * len(S.CLASSES) + F.col("k") if by else F.col("k")
    hits = [F.count_if("hit").alias("pos"), F.count_if(~F.col("hit")).alias("neg")]
    rows = scored.select(*by, "y", "proba")
    large = max((p["distinct"] for p in profiles.values()), default=0) > plain_rows
    dealt = []
    if large:
        tasks = ranges_for(sum(p["distinct"] for p in profiles.values()))
        dealt = ["_task"]
        place = F.pmod(F.hash(F.monotonically_increasing_id()), F.lit(tasks))
        rows = rows.withColumn("_task", place).repartitionById(tasks, "_task")
    counts = (
        rows.select(*dealt, *by, "y", F.posexplode(classes.checked_proba("proba")).alias("k", "score"))
        .select(*dealt, group.cast("int").alias("group"), "score", (F.col("y") == F.col("k")).alias("hit"))
        .groupBy(*dealt, "group", "score")
        .agg(*hits)
    )
    if large:
        counts = counts.repartition(tasks, "group", "score").groupBy("group", "score").agg(
            F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
        )
    return counts


def _auc(scored: DataFrame, *by: str, plain_rows: int = RANK_ROWS) -> DataFrame:
    """One-vs-rest ROC-AUC per class; a tie counts one half, one-sided truth gives NULL.

    Rows collapse to distinct scores per class before anything is ordered. `by` is empty or one column of small integers, such as the fold.
    """
    width = len(S.CLASSES)
    profiles = _score_profiles(scored, *by)
    counts = _score_counts(scored, profiles, plain_rows, *by)
    running, _ = running_sums(
        counts, "group", "score", ["neg"], plain_rows=plain_rows, profiles=profiles
    )
    below = F.col("upto_neg") - F.col("neg")
    wins = F.sum(F.col("pos").cast("double") * (below + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    auc = running.groupBy("group").agg(F.when(pairs > 0, wins / pairs).alias("roc_auc"))
    part = F.floor(F.col("group") / width).cast("int")
    return auc.select(
        *[part.alias(c) for c in by], (F.col("group") % width).alias("class_pos"), "roc_auc"
    )


def ovr_auc(scored: DataFrame, plain_rows: int = RANK_ROWS) -> DataFrame:
    listed = dimension(scored.sparkSession, **{"class": S.CLASSES})
    return (
        listed.join(_auc(scored, plain_rows=plain_rows), "class_pos", "left")
        .orderBy("class_pos")
        .select("class", "roc_auc")
    )


def per_class_metrics(scored: DataFrame) -> DataFrame:
    """precision, recall, F1, AUC and support of every class, in class order."""
    return per_class_of(confusion_counts(scored), ovr_auc(scored))


def per_class_of(cells: DataFrame, auc: DataFrame) -> DataFrame:
    return (
        _class_scores(_pairs_of(cells))
        .join(auc, "class", "left")
        .orderBy("class_pos")
        .select("class", *_SCORES, "support")
    )


def fold_scores(scored: DataFrame, fold: str = "fold") -> DataFrame:
    """Per-class scores of every fold."""
    return _class_scores(_confusion(scored, fold), fold).join(
        _auc(scored, fold), [fold, "class_pos"], "left"
    )


def scope_scores(scored: DataFrame, fold: str = "fold") -> DataFrame:
    """Per-class scores of every fold and of all rows together, from one scan.

    The rows collapse to at most 25 cells a fold first, and grouping sets add the
    cells up once per fold and once over all. `scope` is the fold as text, or
    'all'; rows without a fold are the scope 'none'.
    """
    cells = _confusion(scored, fold)
    total = F.grouping(fold) == 1
    sets = cells.groupingSets([[fold, "y", "pred"], ["y", "pred"]], fold, "y", "pred").agg(
        F.sum("n").alias("n"), total.alias("total")
    )
    name = F.when(F.col("total"), "all").otherwise(F.coalesce(F.col(fold).cast("string"), F.lit("none")))
    return _class_scores(sets.select(name.alias("scope"), "y", "pred", "n"), "scope").drop("called")


def fold_std(scored: DataFrame, fold: str = "fold") -> DataFrame:
    """Population std over folds of each per-class score.

    An AUC that is undefined in some fold leaves its std undefined.
    """
    defined = F.count("roc_auc") == F.count("*")
    return (
        fold_scores(scored, fold)
        .groupBy("class_pos", "class")
        .agg(
            *[F.stddev_pop(c).alias(c) for c in _SCORES[:3]],
            F.when(defined, F.stddev_pop("roc_auc")).alias("roc_auc"),
        )
        .orderBy("class_pos")
        .drop("class_pos")
    )


def false_alarms(scored: DataFrame) -> DataFrame:
    """Healthy rows predicted as any failure."""
    return false_alarms_of(confusion_counts(scored))


def false_alarms_of(cells: DataFrame) -> DataFrame:
    needless = (F.col("true") == S.NO_FAILURE) & (F.col("predicted") != S.NO_FAILURE)
    return cells.agg(F.sum(F.when(needless, F.col("n_rows")).otherwise(0)).alias("false_alarms"))


def metric_long(table: DataFrame, prefix: str, suffix: str = "") -> DataFrame:
    """(metric, value) rows named prefix_metric_class[suffix]; support is a count, no score."""
    scores = [c for c in table.columns if c in _SCORES]
    return table.unpivot(["class"], scores, "score", "value").select(
        F.concat(
            F.lit(f"{prefix}_"), F.col("score"), F.lit("_"), F.col("class"), F.lit(suffix)
        ).alias("metric"),
        "value",
    )


def misclassified_rows(scored: DataFrame, id_column: str = "udi") -> DataFrame:
    """Wrong rows with predicted, runner-up and true probabilities."""
    wrong = predicted(scored).where(F.col("pred") != F.col("y"))

    def p(code):
        return F.element_at("proba", F.col(code) + 1)

    return wrong.select(
        id_column,
        classes.class_name("y").alias("true"),
        classes.class_name("pred").alias("predicted"),
        p("pred").alias("p_predicted"),
        classes.class_name("runner_up").alias("runner_up"),
        p("runner_up").alias("p_runner_up"),
        p("y").alias("p_true"),
    )


def _summary(class_scores: DataFrame, *by: str) -> DataFrame:
    """Macro-F1 over all classes, over the labels seen, and balanced accuracy."""
    seen = (F.col("support") > 0) | (F.col("called") > 0)
    return class_scores.groupBy(*by).agg(
        F.avg("f1").alias("f1_macro_all"),
        F.avg(F.when(seen, F.col("f1"))).alias("f1_macro_seen"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
    )


def summary_scores(scored: DataFrame) -> DataFrame:
    """One row: macro-F1 over all five classes (the test-set form), over the labels
    that occur (the fold form), and balanced accuracy over the true classes."""
    return summary_of(confusion_counts(scored))


def summary_of(cells: DataFrame) -> DataFrame:
    return _summary(_class_scores(_pairs_of(cells)))


def cv_scores(scored: DataFrame, fold: str = "fold") -> DataFrame:
    """Mean and population std over folds of macro-F1 and balanced accuracy."""
    per_fold = _summary(_class_scores(_confusion(scored, fold), fold), fold)
    return per_fold.agg(
        F.avg("f1_macro_seen").alias("cv_f1_macro_mean"),
        F.stddev_pop("f1_macro_seen").alias("cv_f1_macro_std"),
        F.avg("balanced_accuracy").alias("cv_balanced_accuracy_mean"),
        F.stddev_pop("balanced_accuracy").alias("cv_balanced_accuracy_std"),
    )


def macro_auc(scored: DataFrame) -> DataFrame:
    """Mean AUC twice: undefined if any class is (out of fold), and over defined ones."""
    return macro_of(ovr_auc(scored))


def macro_of(auc: DataFrame) -> DataFrame:
    mean = F.avg("roc_auc")
    defined = F.count("roc_auc") == F.count("*")
    return auc.agg(
        F.when(defined, mean).alias("roc_auc_macro_strict"), mean.alias("roc_auc_macro_defined")
    )


def runner_up_hit_rate(scored: DataFrame) -> DataFrame:
    """Of the misclassified real failures, how many have the truth as runner-up."""
    wrong = predicted(scored).where((F.col("pred") != F.col("y")) & ~classes.healthy("y"))
    hits = F.count_if(F.col("runner_up") == F.col("y"))
    return wrong.agg(
        F.count("*").alias("n_errors"),
        hits.alias("n_runner_up"),
        (hits / F.nullif(F.count("*"), F.lit(0))).alias("hit_rate"),
    )


def error_margin(
    errors: DataFrame, features: DataFrame, near: float = 0.05, far: float = 0.12
) -> DataFrame:
    """How close each error on a physics-rule mode lies to that mode's nearest limit."""
    mode = F.when(F.col("true").isin("HDF", "PWF", "OSF"), F.col("true")).when(
        F.col("predicted").isin("HDF", "PWF", "OSF"), F.col("predicted")
    )
    joined = (
        errors.withColumn("mode", mode)
        .where(F.col("mode").isNotNull())
        .join(features, "udi", "left")
    )
    heat = F.least(
        physics.relative_margin("temp_diff_k", S.HEAT_DIFF_LIMIT_K),
        physics.relative_margin(F.col("rotational_speed_rpm").cast("double"), S.HEAT_RPM_LIMIT),
    )
    power = F.least(
        physics.relative_margin("power_w", S.POWER_LOW_W),
        physics.relative_margin("power_w", S.POWER_HIGH_W),
    )
    strain = physics.relative_margin("strain_min_nm", physics.strain_limit().cast("double"))
    margin = (
        F.when(F.col("mode") == "HDF", heat).when(F.col("mode") == "PWF", power).otherwise(strain)
    )
    band = (
        F.when(F.col("margin") <= near, "near").when(F.col("margin") <= far, "close").otherwise("far")
    )
    return (
        joined.withColumn("margin", margin)
        .groupBy("mode", band.alias("band"))
        .agg(F.count("*").alias("n_errors"))
        .orderBy("mode", "band")
    )
