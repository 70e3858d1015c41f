"""Risk tiers and the review-budget threshold."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch import schema as S
from millwatch.functions import classes
from millwatch.operators.selection import RANK_ROWS, kth_largest
from millwatch.session import dimension


def with_scores(scored: DataFrame) -> DataFrame:
    """Adds `pred`, `runner_up` codes and the confidence score."""
    top = scored.withColumn("pred", classes.top_code(classes.checked_proba("proba")))
    return top.withColumns(
        {
            "runner_up": classes.runner_up_code("proba", "pred"),
            "confidence_score": classes.confidence("proba"),
        }
    )


def confidence_scores(scored: DataFrame, id_column: str = "udi") -> DataFrame:
    return scored.select(id_column, classes.confidence("proba").alias("confidence_score"))


def assign_tiers(scored: DataFrame, threshold: float | Column) -> DataFrame:
    """Scored rows with `risk_tier`."""
    return with_scores(scored).withColumn(
        "risk_tier", classes.tier("pred", "confidence_score", threshold)
    )


@dataclass(frozen=True)
class ThresholdChoice:
    threshold: float
    budget: int
    n_healthy: int
    n_healthy_high: int
    room: int


def choose_threshold(
    scored: DataFrame, budget_fraction: float = S.BUDGET_FRACTION, rank_rows: int = RANK_ROWS
) -> ThresholdChoice:
    """The lowest threshold that keeps flagged healthy rows within the budget.

    It is the (room + 1)-th largest score of the healthy rows that are not high
    already. The room grows with the data, so the score is found by narrowing
    value ranges (`kth_largest`), never by sorting the rows.
    """
    top = classes.top_code(classes.checked_proba("proba"))
    healthy = scored.where(classes.healthy("y")).select(
        (top != 0).alias("is_high"), classes.confidence("proba").alias("score")
    )
    candidate = F.when(~F.col("is_high"), F.col("score"))
    counts = healthy.agg(
        F.count("*").alias("n_healthy"),
        F.count_if("is_high").alias("n_healthy_high"),
        F.min(candidate).alias("lo"),
        F.max(candidate).alias("hi"),
    ).first()
    n_healthy, n_high = counts["n_healthy"], counts["n_healthy_high"]
    budget = math.floor(budget_fraction * n_healthy)
    room = budget - n_high
    if room < 0:
        raise ValueError(
            f"The high tier takes {n_high} healthy rows, more than the {budget} to be reviewed; raise the budget"
        )
    if room >= n_healthy - n_high:
        raise ValueError(
            f"All healthy rows below the high tier fit into a review of {budget}; lower the budget to get a threshold"
        )
    threshold = kth_largest(
        healthy.where(~F.col("is_high")), "score", room, rank_rows=rank_rows,
        bounds=(counts["lo"], counts["hi"], n_healthy - n_high),
    )
    return ThresholdChoice(threshold, budget, n_healthy, n_high, room)


def tier_report(tiered: DataFrame) -> DataFrame:
    """Tier x true class counts, all fifteen cells."""
    counted = tiered.groupBy("risk_tier").agg(
        *[F.count_if(F.col("y") == k).alias(name.lower()) for k, name in enumerate(S.CLASSES)]
    )
    listed = dimension(tiered.sparkSession, risk_tier=S.TIERS)
    return (
        listed.join(counted, "risk_tier", "left")
        .orderBy("risk_tier_pos")
        .select(
            "risk_tier",
            *[F.coalesce(c.lower(), F.lit(0)).cast("long").alias(c.lower()) for c in S.CLASSES],
        )
    )


def tier_hit_rate(tiered: DataFrame) -> DataFrame:
    """Rows, real failures and hit rate per tier, and for all rows together."""
    failures = F.count_if(~classes.healthy("y"))
    return (
        tiered.rollup("risk_tier")
        .agg(
            F.count("*").alias("n_rows"),
            failures.alias("n_failures"),
            (failures / F.count("*")).alias("hit_rate"),
        )
        .withColumn("risk_tier", F.coalesce("risk_tier", F.lit("all")))
    )


def flag_counts(tiered: DataFrame) -> DataFrame:
    is_flagged = classes.flagged("risk_tier")
    return tiered.agg(
        F.count_if(is_flagged & classes.healthy("y")).alias("healthy_flagged"),
        F.count_if(is_flagged & (F.col("y") == S.CLASSES.index("TWF"))).alias("twf_flagged"),
    )


def log_rows(scored: DataFrame, threshold: float, model_name: str, model_version: int) -> DataFrame:
    """Scored model inputs as log columns, in log order, after any other columns.

    `scored` holds the nine inputs and `proba`.
    """
    tiered = assign_tiers(scored, threshold)
    computed = {
        "model_name": F.lit(model_name),
        "model_version": F.lit(int(model_version)),
        "predicted_mode": classes.class_name("pred"),
        "runner_up_mode": classes.class_name("runner_up"),
        "elevated_threshold": F.lit(float(threshold)),
    }
    computed |= {c: F.element_at("proba", k + 1) for k, c in enumerate(S.PROBA_COLUMNS)}
    working = {"proba", "pred", "runner_up", *S.LOG_COLUMNS}
    kept = [c for c in scored.columns if c not in working]
    return tiered.select(
        *kept, *[computed[c].alias(c) if c in computed else F.col(c) for c in S.LOG_COLUMNS]
    )


def recommendations(log: DataFrame) -> DataFrame:
    """The published answer for each log row: thirteen fields, two of them nested."""

    def probability_of(mode: str) -> Column:
        position = F.array_position(F.array(*[F.lit(c) for c in S.CLASSES]), F.col(mode))
        return F.element_at(classes.proba_array(), position.cast("int"))

    return log.select(
        "request_id",
        "created_at",
        "model_name",
        "model_version",
        classes.flagged("risk_tier").alias("flagged"),
        "risk_tier",
        "confidence_score",
        "predicted_mode",
        probability_of("predicted_mode").alias("predicted_probability"),
        "runner_up_mode",
        probability_of("runner_up_mode").alias("runner_up_probability"),
        F.struct(
            *[F.col(p).alias(name) for p, name in zip(S.PROBA_COLUMNS, S.CLASSES)]
        ).alias("class_probabilities"),
        F.struct(*[F.col(c) for c in S.PHYSICS]).alias("physics_features"),
    )
