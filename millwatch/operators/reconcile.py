"""Joins and set comparisons: alignment, reproduction, parity and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch import schema as S


def score_label_join(scores: DataFrame, labels: DataFrame, key: str = "udi") -> DataFrame:
    """Scores with their labels by row id."""
    return scores.join(labels, key)


def alignment(scores: DataFrame, labels: DataFrame, key: str = "udi") -> DataFrame:
    """(n_matched, n_scores_only, n_labels_only): the length check of an aligned pair.

    Each side is collapsed to its key first, so only keys are shuffled.
    """
    left = scores.groupBy(key).agg(F.count("*").alias("n_scores"))
    right = labels.groupBy(key).agg(F.count("*").alias("n_labels"))
    n_scores = F.coalesce("n_scores", F.lit(0))
    n_labels = F.coalesce("n_labels", F.lit(0))
    none = F.lit(0).cast("long")
    return left.join(right, key, "full_outer").agg(
        F.coalesce(F.sum(F.least(n_scores, n_labels)), none).alias("n_matched"),
        F.coalesce(F.sum(F.greatest(n_scores - n_labels, F.lit(0))), none).alias("n_scores_only"),
        F.coalesce(F.sum(F.greatest(n_labels - n_scores, F.lit(0))), none).alias("n_labels_only"),
    )


def require_aligned(scores: DataFrame, labels: DataFrame, key: str = "udi") -> None:
    row = alignment(scores, labels, key).first()
    if row["n_scores_only"] or row["n_labels_only"]:
        n_scores = row["n_matched"] + row["n_scores_only"]
        n_labels = row["n_matched"] + row["n_labels_only"]
        raise ValueError(
            f"Scores and labels must be of the same ids, not {n_labels} labels but {n_scores} scores: "
            f"{row['n_scores_only']} of {n_scores} scored ids have no label, "
            f"{row['n_labels_only']} of {n_labels} labelled ids have no score; score the rows of this run's training split"
        )


def errors_with_readings(errors: DataFrame, readings: DataFrame, key: str = "udi") -> DataFrame:
    """Every misclassified row with its reading; an error without one stays visible."""
    return errors.join(readings, key, "left")


def responses_not_logged(responses: DataFrame, log: DataFrame) -> DataFrame:
    """Responses without a log row of the same id, tier, version and threshold."""
    keys = ["request_id", "risk_tier", "model_version", "elevated_threshold"]
    return responses.join(log.select(*keys), keys, "left_anti")


def matrix_differences(recomputed: DataFrame, logged: DataFrame) -> DataFrame:
    """Cells of two (true, predicted, n_rows) matrices that differ, at most 25 rows."""
    left = recomputed.select("true", "predicted", F.col("n_rows").alias("n_recomputed"))
    right = logged.select("true", "predicted", F.col("n_rows").alias("n_logged"))
    joined = left.join(right, ["true", "predicted"], "full_outer")
    return joined.where(~F.col("n_recomputed").eqNullSafe(F.col("n_logged")))


def require_reproduced(recomputed: DataFrame, logged: DataFrame, run_id: str) -> None:
    cells = matrix_differences(recomputed, logged).collect()
    if cells:
        shown = ", ".join(
            f"{c['true']} as {c['predicted']} {c['n_recomputed']} times ({c['n_logged']} logged)"
            for c in cells
        )
        raise RuntimeError(f"Recomputing run {run_id} gives other counts than its log: {shown}")


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(n_left_only, n_right_only) with duplicates counted, as EXCEPT ALL both ways.

    One aggregation of +1/-1 marks, collapsed on the map side, in place of two
    EXCEPT ALL plans. Doubles compare by value, so 1 ulp is a difference.
    """
    columns = left.columns
    marked = left.withColumn("_mark", F.lit(1)).unionByName(
        right.select(columns).withColumn("_mark", F.lit(-1))
    )
    net = marked.groupBy(*columns).agg(F.sum("_mark").alias("_net"))
    none = F.lit(0).cast("long")
    return net.agg(
        F.coalesce(F.sum(F.greatest("_net", F.lit(0))), none).alias("n_left_only"),
        F.coalesce(F.sum(F.greatest(-F.col("_net"), F.lit(0))), none).alias("n_right_only"),
    )


def load_totals(table: DataFrame) -> DataFrame:
    """(metric, n) totals of a loaded or staged table: rows, grades, failures, nulls."""
    columns = [c for c in S.CSV_COLUMNS.values() if c in table.columns]
    totals = {"rows": F.count("*")}
    totals |= {f"type_{g}": F.count_if(F.col("type") == g) for g in S.GRADES}
    totals |= {flag: F.count_if(F.col(flag).cast("boolean")) for flag in S.FLAGS}
    totals["null_cells"] = sum(
        (F.count_if(F.col(c).isNull()) for c in columns[1:]), F.count_if(F.col(columns[0]).isNull())
    )
    return table.agg(*[expr.alias(name) for name, expr in totals.items()]).unpivot(
        [], list(totals), "metric", "n"
    )


def source_reconciliation(source: DataFrame, table: DataFrame) -> DataFrame:
    """File totals next to table totals, metric by metric."""
    left = load_totals(source).withColumnRenamed("n", "n_source")
    right = load_totals(table).withColumnRenamed("n", "n_table")
    return left.join(right, "metric", "full_outer").withColumn(
        "is_equal", F.col("n_source").eqNullSafe(F.col("n_table"))
    )
