"""Feature drift and workload of a window of scored requests.

Numeric columns score the 1-D Wasserstein distance over the reference's
population std; the grade scores the Jensen-Shannon distance of its shares.
Both start from counts per (column, value), collapsed on the map side, so what
is ordered afterwards is distinct sensor values, not rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwatch import schema as S
from millwatch.operators.audits import shares_of
from millwatch.operators.selection import (
    RANK_ROWS,
    at_or_before,
    group_profiles,
    rank_cuts,
    running_sums,
)
from millwatch.session import materialise


# ---------------------------------------------------------------------------
# Counts per column and value
# ---------------------------------------------------------------------------


def numeric_counts(df: DataFrame, columns: Sequence[str] = S.NUMERIC_FEATURES) -> DataFrame:
    """(column, value, n = 1): one narrow row per input row and column."""
    casted = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return (
        casted.unpivot([], list(columns), "column", "value")
        .where(F.col("value").isNotNull())
        .withColumn("n", F.lit(1).cast("long"))
    )


def category_counts(
    df: DataFrame, columns: Sequence[str] = S.CATEGORICAL_FEATURES
) -> DataFrame:
    """(column, category, n = 1): one narrow row per input row and column."""
    return (
        df.select(*columns)
        .unpivot([], list(columns), "column", "category")
        .withColumn("n", F.lit(1).cast("long"))
    )


def reference_profile(
    reference: DataFrame,
    columns: Sequence[str] = S.NUMERIC_FEATURES,
    categorical: Sequence[str] = S.CATEGORICAL_FEATURES,
) -> DataFrame:
    """All that a drift score needs of the reference: (column, value, category, n).

    Written once with the model, it lets every monitoring run read the distinct
    values of the training rows instead of the rows.
    """
    numeric = (
        numeric_counts(reference, columns)
        .groupBy("column", "value")
        .agg(F.sum("n").alias("n"))
        .select("column", "value", F.lit(None).cast("string").alias("category"), "n")
    )
    if not categorical:
        return numeric
    categories = (
        category_counts(reference, categorical)
        .groupBy("column", "category")
        .agg(F.sum("n").alias("n"))
        .select("column", F.lit(None).cast("double").alias("value"), "category", "n")
    )
    return numeric.unionByName(categories)


def _both(reference: DataFrame, current: DataFrame, value: str) -> DataFrame:
    """(column, <value>, n_ref, n_cur): the counts of two sides next to each other."""
    none = F.lit(0).cast("long")
    left = reference.select("column", value, F.col("n").alias("n_ref"), none.alias("n_cur"))
    right = current.select("column", value, none.alias("n_ref"), F.col("n").alias("n_cur"))
    return (
        left.unionByName(right)
        .groupBy("column", value)
        .agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    )


def _per_column(profiles: dict, key: str) -> Column:
    picked = F
    for column, profile in profiles.items():
        picked = picked.when(F.col("column") == column, F.lit(profile[key]))
    return picked


def wasserstein_between(
    reference: DataFrame, current: DataFrame, plain_rows: int = RANK_ROWS
) -> DataFrame:
    """(column, score) of two sides given as (column, value, n) counts, collapsed or not.

    The score is the area between the two step CDFs over the reference's std. A
    constant or empty reference column has no scale: its score is NULL.
    """
    counts = _both(reference, current, "value")
    running, profiles = running_sums(
        counts, "column", "value", ["n_ref", "n_cur"], plain_rows=plain_rows
    )
    if not profiles:
        return reference.sparkSession.createDataFrame([], "column string, score double")
    n_ref = _per_column(profiles, "total_n_ref").cast("double")
    n_cur = _per_column(profiles, "total_n_cur").cast("double")
    gap = F.abs(F.col("upto_n_ref") / n_ref - F.col("upto_n_cur") / n_cur)
    deviation = F.col("value") - _per_column(profiles, "mean_n_ref")
    usable = (n_ref > 0) & (n_cur > 0)
    terms = running.where(usable).select(
        "column",
        (gap * (F.col("next_value") - F.col("value"))).alias("area"),
        (F.col("n_ref") * deviation * deviation / n_ref).alias("variance"),
    )
    std = F.sqrt(F.sum("variance"))
    return terms.groupBy("column").agg(F.when(std > 0, F.sum("area") / std).alias("score"))


def wasserstein_drift(
    reference: DataFrame,
    current: DataFrame,
    columns: Sequence[str] = S.NUMERIC_FEATURES,
    plain_rows: int = RANK_ROWS,
) -> DataFrame:
    """(column, score) of two tables of rows."""
    return wasserstein_between(
        numeric_counts(reference, columns), numeric_counts(current, columns), plain_rows
    )


def _entropy_term(share: Column, middle: Column) -> Column:
    return F.when(share > 0, share * F.log(share / middle)).otherwise(0.0)


def js_between(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(column, score) of two sides given as (column, category, n) counts.

    The score is the Jensen-Shannon distance, natural logarithm, of the shares.
    """
    counts = _both(reference, current, "category").withColumnsRenamed({"n_ref": "r", "n_cur": "c"})
    # One row per column, so the totals are safe to broadcast.
    totals = counts.groupBy("column").agg(F.sum("r").alias("n_r"), F.sum("c").alias("n_c"))
    shares = (
        counts.join(F.broadcast(totals), "column")
        .select(
            "column",
            (F.col("r") / F.nullif("n_r", F.lit(0))).alias("p"),
            (F.col("c") / F.nullif("n_c", F.lit(0))).alias("q"),
        )
        .withColumn("m", (F.col("p") + F.col("q")) / 2)
    )
    divergence = _entropy_term(F.col("p"), F.col("m")) + _entropy_term(F.col("q"), F.col("m"))
    defined = F.count("m") == F.count("*")
    return shares.groupBy("column").agg(
        F.when(defined, F.sqrt(F.greatest(F.sum(divergence) / 2, F.lit(0.0)))).alias("score")
    )


def js_drift(
    reference: DataFrame, current: DataFrame, columns: Sequence[str] = S.CATEGORICAL_FEATURES
) -> DataFrame:
    """(column, score) of two tables of rows."""
    return js_between(category_counts(reference, columns), category_counts(current, columns))


# ---------------------------------------------------------------------------
# Verdicts
# ---------------------------------------------------------------------------


def column_verdicts(scores: DataFrame, threshold: float = S.DRIFT_THRESHOLD) -> DataFrame:
    """(column, method, threshold, score, drifted); a score that is NULL or NaN fails."""
    undefined = F.raise_error(F.concat(F.lit("Drift score undefined for "), F.col("column")))
    score = F.when(
        F.col("score").isNotNull() & ~F.isnan("score"), F.col("score")
    ).otherwise(undefined.cast("double"))
    method = F.when(F.col("column").isin(*S.CATEGORICAL_FEATURES), S.JENSEN_SHANNON).otherwise(
        S.WASSERSTEIN
    )
    checked = scores.select("column", score.alias("score"))
    return checked.select(
        "column",
        method.alias("method"),
        F.lit(threshold).alias("threshold"),
        "score",
        (F.col("score") >= threshold).alias("drifted"),
    )


def require_covered(verdicts: DataFrame, columns: Sequence[str] = S.FEATURES) -> None:
    found = {r["column"] for r in verdicts.select("column").collect()}
    if found != set(columns):
        odd = sorted(found.symmetric_difference(columns))
        raise ValueError(f"Every model input needs one verdict and nothing else has one; look at {odd}")


def drift_verdicts(
    reference: DataFrame, current: DataFrame, threshold: float = S.DRIFT_THRESHOLD
) -> DataFrame:
    """One verdict per model input."""
    scores = wasserstein_drift(reference, current).unionByName(js_drift(reference, current))
    return column_verdicts(scores, threshold)


def profile_verdicts(
    profile: DataFrame, current: DataFrame, threshold: float = S.DRIFT_THRESHOLD
) -> DataFrame:
    """One verdict per model input, against a stored reference profile."""
    numeric = wasserstein_between(
        profile.where(F.col("value").isNotNull()), numeric_counts(current)
    )
    categories = js_between(
        profile.where(F.col("column").isin(*S.CATEGORICAL_FEATURES)), category_counts(current)
    )
    return column_verdicts(numeric.unionByName(categories), threshold)


def dataset_verdict(verdicts: DataFrame, columns: Sequence[str] = S.FEATURES) -> DataFrame:
    """One row: drift if any column drifted; the share rule must agree.

    An input without a verdict, or a disagreement, fails the job.
    """
    n = len(columns)
    known = F.count_if(F.col("column").isin(*columns))
    summary = verdicts.agg(
        F.count("*").alias("n_columns"),
        known.alias("n_known"),
        F.count_if("drifted").alias("n_drifted"),
        F.bool_or("drifted").alias("any_drifted"),
        F.array_join(
            F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("column")))), ","
        ).alias("drifted_columns"),
    )
    by_share = F.col("n_drifted") / F.col("n_columns") >= F.lit(1) / F.lit(n)
    complete = (F.col("n_columns") == n) & (F.col("n_known") == n)
    verdict = (
        F.when(~complete, F.raise_error(F.lit(f"Drift tests must cover exactly {list(columns)}")))
        .when(
            by_share != F.col("any_drifted"),
            F.raise_error(F.lit("The share of drifted columns and their flags give different verdicts; compute both from the same column scores")),
        )
        .when(F.col("any_drifted"), F.lit("drift"))
        .otherwise(F.lit("no_drift"))
    )
    return summary.select(
        verdict.alias("verdict"),
        "n_drifted",
        F.coalesce(F.nullif("drifted_columns", F.lit("")), F.lit("none")).alias("drifted_columns"),
    )


# ---------------------------------------------------------------------------
# Workload and the monitoring window
# ---------------------------------------------------------------------------


def window_counts(current: DataFrame) -> DataFrame:
    """One row: requests in the window and per tier."""
    return current.agg(
        F.count("*").alias("n_current"),
        *[F.count_if(F.col("risk_tier") == t).alias(t) for t in S.TIERS],
    )


def workload_vs_expected(
    current: DataFrame, expected_flagged: float = S.EXPECTED_FLAGGED_SHARE
) -> DataFrame:
    """Tier shares and the flagged share against the expected one."""
    shares = shares_of(window_counts(current))
    return shares.withColumn("flagged_vs_expected", F.col("share_flagged") / expected_flagged)


def data_gate(current: DataFrame, min_rows: int = S.MIN_WINDOW_ROWS) -> DataFrame:
    """(n_current, enough): whether a window may get a verdict at all."""
    return current.agg(F.count("*").alias("n_current")).withColumn(
        "status",
        F.when(F.col("n_current") >= min_rows, "enough_data").otherwise(S.INSUFFICIENT_DATA),
    )


def drift_window(
    reference: DataFrame,
    current: DataFrame,
    since: str,
    min_rows: int = S.MIN_WINDOW_ROWS,
    expected_flagged: float = S.EXPECTED_FLAGGED_SHARE,
) -> tuple[DataFrame, DataFrame | None]:
    """(window row, verdict rows or None) of one monitoring run.

    `current` holds the nine inputs and `risk_tier`; `reference` the nine inputs,
    or the profile of them. The counts of the window, one row, decide on the
    driver whether the drift plan is built at all.
    """
    spark = current.sparkSession
    is_profile = "category" in reference.columns
    counts = window_counts(current).first().asDict()
    n_current = counts["n_current"]
    if is_profile:
        one_column = reference.where(F.col("column") == S.CATEGORICAL_FEATURES[0])
        n_reference = one_column.agg(F.sum("n")).first()[0]
    else:
        n_reference = reference.count()
    verdicts, verdict, n_drifted, drifted = None, S.INSUFFICIENT_DATA, None, None
    if n_current >= min_rows:
        build = profile_verdicts if is_profile else drift_verdicts
        verdicts = materialise(build(reference, current))
        summary = dataset_verdict(verdicts).first()
        verdict, n_drifted = summary["verdict"], summary["n_drifted"]
        drifted = summary["drifted_columns"]
    shares: dict[str, float | None] = {t: None for t in (*S.TIERS, "flagged")}
    total = sum(counts[t] for t in S.TIERS)
    if total:
        shares = {t: counts[t] / total for t in S.TIERS}
        shares["flagged"] = shares["elevated"] + shares["high"]
    ratio = None if shares["flagged"] is None else shares["flagged"] / expected_flagged
    row = {
        "since": since,
        "n_reference": n_reference,
        "n_current": n_current,
        "min_rows": min_rows,
        **{f"share_{name}": value for name, value in shares.items()},
        "flagged_vs_expected": ratio,
        "verdict": verdict,
        "n_drifted": n_drifted,
        "drifted_columns": drifted,
    }
    return spark.createDataFrame([tuple(row.values())], WINDOW_SCHEMA), verdicts


WINDOW_SCHEMA = (
    "since string, n_reference long, n_current long, min_rows int, "
    "share_low double, share_elevated double, share_high double, share_flagged double, "
    "flagged_vs_expected double, verdict string, n_drifted long, drifted_columns string"
)


# ---------------------------------------------------------------------------
# False alarms of healthy windows
# ---------------------------------------------------------------------------


_RANKED_TOGETHER = 5000


def healthy_windows(
    rows: DataFrame, size: int, windows: int, seed: str | int = S.SEED, id_column: str = "udi"
) -> DataFrame:
    """`windows` random windows of exactly `size` rows, each without repeats.

    Rows are dealt in a seeded hash order, `size` to a window. When they run out,
    they are dealt again in a new order (a lap), so the work is about
    windows x size rows however large the table is; with one lap, rows beyond
    the last needed rank are cut off by their hash first. A row's place is its
    rank among the hashes of its lap that begin alike, plus the counts of the
    beginnings before, so no lap is sorted in one task and the plan is the same
    for any number of windows.
    """
    total = rows.count()
    per_lap = total // size
    if per_lap == 0:
        raise ValueError(f"{total} rows cannot fill a window of {size}")
    laps = -(-windows // per_lap)
    hashed = F.md5(
        F.concat(
            F.lit(f"window-{seed}-{size}-"), F.col("_lap").cast("string"), F.lit(":"),
            F.col(id_column).cast("string"),
        )
    )
    keyed = rows.withColumn("_lap", F.explode(F.sequence(F.lit(0), F.lit(laps - 1)))).withColumn("_h", hashed)
    if laps == 1 and windows * size < total:
        last = keyed.select(F.lit("all").alias("s"), "_h", id_column)
        cut = rank_cuts(last, "s", "_h", id_column, {"all": [windows * size]})["all"][0]
        keyed = keyed.where(at_or_before("_h", id_column, cut))
    digits = max(0, math.ceil(math.log(total / _RANKED_TOGETHER, 16)))
    keyed = keyed.withColumn("_start", F.substring("_h", 1, digits) if digits else F.lit(""))
    earlier = Window.partitionBy("_lap").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy("_lap", "_start").agg(F.count("*").alias("_n"))
        .select("_lap", "_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    among = F.row_number().over(Window.partitionBy("_lap", "_start").orderBy("_h", id_column)) - 1
    window = F.floor(F.col("_position") / size) + F.col("_lap") * per_lap
    return (
        keyed.join(starts, ["_lap", "_start"])
        .withColumn("_position", F.col("_before") + among)
        .where(F.col("_position") < per_lap * size)
        .withColumn("window_id", window.cast("int"))
        .where(F.col("window_id") < windows)
        .drop("_lap", "_h", "_start", "_before", "_position")
    )


@dataclass(frozen=True)
class ReferenceSteps:
    """A reference made ready once for any number of windows."""

    running: DataFrame
    profiles: dict
    categories: DataFrame


def reference_steps(
    reference: DataFrame,
    columns: Sequence[str] = S.NUMERIC_FEATURES,
    categorical: Sequence[str] = S.CATEGORICAL_FEATURES,
    plain_rows: int = RANK_ROWS,
) -> ReferenceSteps:
    profile = materialise(reference_profile(reference, columns, categorical))
    numeric = profile.where(F.col("value").isNotNull()).select("column", "value", "n")
    running, profiles = running_sums(
        numeric, "column", "value", ["n"], plain_rows=plain_rows,
        profiles=group_profiles(numeric, "column", "value", ["n"]),
    )
    return ReferenceSteps(
        running, profiles, profile.where(F.col("column").isin(*categorical))
    )


def window_wasserstein(steps: ReferenceSteps, windows: DataFrame, size: int) -> DataFrame:
    """(window_id, column, score) of many windows of `size` rows against one reference.

    The reference is not repeated per window. In quantile space each of the
    `size` sorted values of a window owns one slot of width 1/size, and the
    distance is the sum over slots of how far the reference values in that slot
    lie from it. The reference is cut into the slots once, weighted in whole
    units (a slot weighs n units, a reference row weighs `size`); running weights
    by value inside a slot then price the values of all windows together.
    """
    running, profiles = steps.running, steps.profiles
    columns = list(profiles)
    n_ref = _per_column(profiles, "total_n").cast("long")
    end = F.col("upto_n") * F.lit(size)
    start = end - F.col("n") * F.lit(size)
    slots = F.sequence(F.expr("int(start div total)"), F.expr("int((end - 1) div total)"))
    pieces = (
        running.select(
            "column", "value", start.alias("start"), end.alias("end"), n_ref.alias("total")
        )
        .withColumn("slot", F.explode(slots))
        .withColumn(
            "weight",
            F.least("end", (F.col("slot") + 1) * F.col("total"))
            - F.greatest("start", F.col("slot") * F.col("total")),
        )
        .where("weight > 0")
        .select("column", "slot", "value", "weight", F.lit(None).cast("int").alias("window_id"))
    )
    # A window holds `size` rows, so its values are ordered in one small group.
    in_window = Window.partitionBy("window_id", "column").orderBy("value")
    values = (
        windows.select("window_id", *[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot(["window_id"], columns, "column", "value")
        .select(
            "column",
            (F.row_number().over(in_window) - 1).alias("slot"),
            "value",
            F.lit(0).cast("long").alias("weight"),
            "window_id",
        )
    )
    slot = Window.partitionBy("column", "slot")
    upto = slot.orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    moment = F.col("weight") * F.col("value")
    priced = pieces.unionByName(values).select(
        "column",
        "value",
        "window_id",
        F.sum("weight").over(upto).alias("w_below"),
        F.sum(moment).over(upto).alias("m_below"),
        F.sum("weight").over(slot).alias("w_all"),
        F.sum(moment).over(slot).alias("m_all"),
    )
    below, above = F.col("w_below"), F.col("w_all") - F.col("w_below")
    cost = (
        F.col("value") * below
        - F.col("m_below")
        + (F.col("m_all") - F.col("m_below"))
        - F.col("value") * above
    )
    # One row per column, so the spread is safe to broadcast.
    deviation = F.col("value") - _per_column(profiles, "mean_n")
    spread = running.groupBy("column").agg(
        F.sqrt(F.sum(F.col("n") * deviation * deviation) / F.sum("n")).alias("std"),
        F.sum("n").cast("double").alias("total"),
    )
    return (
        priced.where(F.col("window_id").isNotNull())
        .groupBy("window_id", "column")
        .agg(F.sum(cost).alias("cost"))
        .join(F.broadcast(spread), "column")
        .select(
            "window_id",
            "column",
            (F.col("cost") / (F.col("total") * F.lit(float(size))) / F.col("std")).alias("score"),
        )
    )


def window_js(
    steps: ReferenceSteps, windows: DataFrame, column: str = S.CATEGORICAL_FEATURES[0]
) -> DataFrame:
    """(window_id, column, score) for one categorical column."""
    counted = steps.categories.where(F.col("column") == column)
    total = counted.agg(F.sum("n")).first()[0]
    p = counted.select("category", (F.col("n") / F.lit(total)).alias("p"))
    per_window = windows.groupBy("window_id", F.col(column).alias("category")).agg(
        F.count("*").alias("c")
    )
    q = per_window.select(
        "window_id",
        "category",
        (F.col("c") / F.sum("c").over(Window.partitionBy("window_id"))).alias("q"),
    )
    # Categories a window lacks still count: their reference share p adds p * ln 2.
    joined = q.join(p, "category", "left")
    share_p, share_q = F.coalesce("p", F.lit(0.0)), F.col("q")
    middle = (share_p + share_q) / 2
    present = F.sum(_entropy_term(share_p, middle) + _entropy_term(share_q, middle))
    absent = (F.lit(1.0) - F.sum(share_p)) * F.log(F.lit(2.0))
    divergence = F.greatest((present + absent) / 2, F.lit(0.0))
    return (
        joined.groupBy("window_id")
        .agg(F.sqrt(divergence).alias("score"))
        .select("window_id", F.lit(column).alias("column"), "score")
    )


def false_alarm_rate(
    reference: DataFrame,
    held_out: DataFrame,
    sizes: Sequence[int],
    windows: int = 200,
    threshold: float = S.DRIFT_THRESHOLD,
    seed: str | int = S.SEED,
) -> DataFrame:
    """(window_size, n_windows, n_alarms, rate): healthy windows with any drifted column.

    A size that the held-out rows can't fill once has no window and a null rate.
    """
    steps = reference_steps(reference)
    held, result = held_out.count(), None
    for size in sizes:
        if size > held:
            zero = F.lit(0).cast("long")
            row = reference.sparkSession.range(1).select(
                F.lit(size).alias("window_size"), zero.alias("n_windows"), zero.alias("n_alarms"), F.lit(None).cast("double").alias("rate")
            )
            result = row if result is None else result.unionByName(row)
            continue
        drawn = materialise(healthy_windows(held_out, size, windows, seed))
        scores = window_wasserstein(steps, drawn, size).unionByName(window_js(steps, drawn))
        alarms = scores.groupBy("window_id").agg(
            F.bool_or(F.col("score") >= threshold).alias("alarm")
        )
        row = alarms.agg(
            F.lit(size).alias("window_size"),
            F.count("*").alias("n_windows"),
            F.count_if("alarm").alias("n_alarms"),
            (F.count_if("alarm") / F.count("*")).alias("rate"),
        )
        result = row if result is None else result.unionByName(row)
    return result
