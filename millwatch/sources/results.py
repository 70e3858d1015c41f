"""Sinks of evaluation tables and monitoring windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch.operators import evaluation
from millwatch.session import materialise

SCORES = "column string, method string, threshold double, score double, drifted boolean"


def log_window(
    window: DataFrame, verdicts: DataFrame | None, root: str, window_id: str
) -> None:
    """Persist one monitoring window and its column scores, none if it had too few rows.

    Both land under the window's id, so repeating a window replaces it, scores of
    a try with more rows included. The scores are written first: a window that can
    be seen has its scores.
    """
    if verdicts is None:
        verdicts = window.sparkSession.createDataFrame([], SCORES)
    verdicts.write.mode("overwrite").parquet(f"{root}/monitor_column_drift/window_id={window_id}")
    window.coalesce(1).write.mode("overwrite").parquet(
        f"{root}/monitor_windows/window_id={window_id}"
    )


def read_scores(spark: SparkSession, root: str) -> DataFrame:
    """Column scores of all windows, with their `window_id`."""
    schema = f"{SCORES}, window_id string"
    return spark.read.schema(schema).parquet(f"{root}/monitor_column_drift")


def evaluation_tables(scored: DataFrame, prefix: str, sealed: bool = False) -> dict[str, DataFrame]:
    """Everything an evaluation stores, by table name.

    The confusion cells and the AUCs, a few rows each, are computed once; all
    other tables but the errors follow from them. Out of fold, the macro AUC is
    undefined if any class is; on the sealed rows it averages the defined ones,
    next to macro-F1 over all classes and balanced accuracy.
    """
    cells = materialise(evaluation.confusion_counts(scored))
    auc = materialise(evaluation.ovr_auc(scored))
    per_class = evaluation.per_class_of(cells, auc)
    macro = "roc_auc_macro_defined" if sealed else "roc_auc_macro_strict"
    single = [
        evaluation.false_alarms_of(cells),
        evaluation.macro_of(auc).select(F.col(macro).alias("roc_auc_macro")),
    ]
    if sealed:
        summary = evaluation.summary_of(cells)
        single.append(summary.select(F.col("f1_macro_all").alias("f1_macro"), "balanced_accuracy"))
    metrics = evaluation.metric_long(per_class, prefix)
    for table in single:
        named = table.select(
            *[F.col(c).cast("double").alias(f"{prefix}_{c}") for c in table.columns]
        )
        metrics = metrics.unionByName(named.unpivot([], named.columns, "metric", "value"))
    return {
        "metrics": metrics,
        "per_class": per_class,
        "confusion_counts": cells,
        "confusion_normalised": evaluation.normalised_of(cells),
        "errors": evaluation.misclassified_rows(scored),
    }


def write_evaluation(tables: dict[str, DataFrame], root: str, run_id: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{root}/{name}/run_id={run_id}")
