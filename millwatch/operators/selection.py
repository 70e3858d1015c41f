"""Exact order statistics and running sums without one global sort.

Three shapes recur below: the rank cut of a hashed order inside each stratum,
the k-th largest value of a column, and running sums over the distinct values of
many groups. Each narrows with counts that are summed on the map side; what
reaches the driver is a few boundary rows, whose number depends on the classes
and columns, not on the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwatch.session import materialise

_HEX_STEP = 3
_HASH_WIDTH = 32
# How many rows one task may sort: beyond it the range is narrowed further.
RANK_ROWS = 200_000
# How many values a range should hold, and how many ranges there are at least.
RANGE_ROWS = 1_000_000
_FEWEST_RANGES = 64

CutKey = tuple[str, int]


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def rank_cuts(
    df: DataFrame,
    stratum: str,
    hash_column: str,
    id_column: str,
    ranks: Mapping[object, Sequence[int]],
    rank_rows: int = RANK_ROWS,
) -> dict[object, list[CutKey]]:
    """(hash, id) of the row at each wanted 1-based rank of each stratum.

    Rows are ordered by (hash, id) inside a stratum. Each round counts the next
    three hex digits within the prefixes still wanted, at most 4,096 counts for
    each; once every wanted prefix holds few rows, only those are ranked.
    """
    rows = df.select(
        F.col(stratum).alias("s"), F.col(hash_column).alias("h"), F.col(id_column).alias("i")
    )
    # (stratum, rank) -> (prefix holding that rank, rank inside the prefix)
    wanted = {(s, k): ("", k) for s, ks in ranks.items() for k in ks}
    if not wanted:
        return {s: [] for s in ranks}
    depth = 0

    def in_scope(column: str) -> Column:
        """Rows under a wanted prefix. The hash is named once: a pushed-down filter
        computes it again for every mention."""
        prefixes = {f"{s}:{prefix}" for (s, _), (prefix, _) in wanted.items()}
        key = F.concat(F.col("s").cast("string"), F.lit(":"), F.substring(column, 1, depth))
        return key.isin(*sorted(prefixes))

    largest = None
    while largest is None or (largest > rank_rows and depth < _HASH_WIDTH):
        scoped = rows.where(in_scope("h"))
        depth += _HEX_STEP
        counts = scoped.groupBy("s", F.substring("h", 1, depth).alias("p")).agg(
            F.count("*").alias("n")
        )
        parent = F.substring("p", 1, depth - _HEX_STEP)
        upto = F.sum("n").over(Window.partitionBy("s", parent).orderBy("p"))
        holds_a_rank = _any(
            [
                (F.col("s") == s) & F.col("p").startswith(prefix)
                & (F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)
                for (s, _), (prefix, k) in wanted.items()
            ]
        )
        hits = counts.withColumn("upto", upto).where(holds_a_rank).collect()
        largest = 0
        for (s, rank), (prefix, k) in wanted.items():
            hit = next(
                (
                    r for r in hits
                    if r["s"] == s and r["p"].startswith(prefix)
                    and r["upto"] - r["n"] < k <= r["upto"]
                ),
                None,
            )
            if hit is None:
                raise ValueError(f"Stratum {s!r} has fewer than {rank} rows")
            wanted[(s, rank)] = (hit["p"], k - (hit["upto"] - hit["n"]))
            largest = max(largest, hit["n"])

    prefixed = rows.where(in_scope("h")).withColumn("p", F.substring("h", 1, depth))
    position = F.row_number().over(Window.partitionBy("s", "p").orderBy("h", "i"))
    at_a_rank = _any(
        [
            (F.col("s") == s) & (F.col("p") == prefix) & (F.col("position") == k)
            for (s, _), (prefix, k) in wanted.items()
        ]
    )
    found = {
        (r["s"], r["p"], r["position"]): (r["h"], r["i"])
        for r in prefixed.withColumn("position", position).where(at_a_rank).collect()
    }
    return {s: [found[(s, *wanted[(s, k)])] for k in ks] for s, ks in ranks.items()}


def at_or_before(hash_column: str, id_column: str, cut: CutKey) -> Column:
    """Whether a row sits at or before a cut in (hash, id) order."""
    h, i = cut
    return (F.col(hash_column) < h) | ((F.col(hash_column) == h) & (F.col(id_column) <= i))


def kth_largest(
    df: DataFrame,
    column: str,
    offset: int,
    fanout: int = 4096,
    rank_rows: int = RANK_ROWS,
    bounds: tuple[float, float, int] | None = None,
) -> float:
    """The value at a 0-based position in descending order, ties counted per row.

    `bounds` is (lowest, highest, count) where the caller knows them already.

    Each round splits the live range into `fanout` equal steps (a monotone map,
    so order survives), counts them, and keeps the step holding the position.
    A value shared by any share of the rows ends as a range of width zero.
    """
    values = df.select(F.col(column).cast("double").alias("x")).where(
        F.col("x").isNotNull() & ~F.isnan("x")
    )
    if bounds is None:
        bounds = tuple(values.agg(F.min("x"), F.max("x"), F.count("*")).first())
    lo, hi, n = bounds
    if not 0 <= offset < n:
        raise ValueError(f"Position {offset} outside {n} values")
    while lo < hi and n > rank_rows:
        step = F.least(
            F.floor((F.col("x") - F.lit(lo)) / F.lit(hi - lo) * F.lit(fanout)), F.lit(fanout - 1)
        )
        steps = (
            values.where(F.col("x").between(lo, hi))
            .groupBy(step.alias("step"))
            .agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            .withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("step"))))
        )
        hit = steps.where((F.col("upto") > offset) & (F.col("upto") - F.col("n") <= offset)).first()
        offset -= hit["upto"] - hit["n"]
        lo, hi, n = hit["lo"], hit["hi"], hit["n"]
    if lo == hi:
        return float(lo)
    inside = values.where(F.col("x").between(lo, hi))
    return float(inside.orderBy(F.desc("x")).offset(offset).limit(1).first()["x"])


def group_profiles(
    counts: DataFrame,
    group: str,
    value: str,
    sums: Sequence[str],
) -> dict[object, dict]:
    """Per group: distinct values, totals and weighted means."""
    rows = (
        counts.groupBy(group)
        .agg(
            F.count("*").alias("distinct"),
            *[F.sum(s).alias(f"total_{s}") for s in sums],
            *[(F.sum(F.col(s) * F.col(value)) / F.sum(s)).alias(f"mean_{s}") for s in sums],
        )
        .collect()
    )
    return {row[group]: row.asDict() for row in rows}


def ranges_for(values: int) -> int:
    """Into how many ranges, or tasks, so many values are dealt."""
    return max(_FEWEST_RANGES, -(-values // RANGE_ROWS))


def running_sums(
    counts: DataFrame,
    group: str,
    value: str,
    sums: Sequence[str],
    plain_rows: int = RANK_ROWS,
    profiles: dict[object, dict] | None = None,
) -> tuple[DataFrame, dict[object, dict]]:
    """Running totals of `sums` by ascending value, and the value that follows.

    `counts` holds one row per (group, value). Adds `upto_<sum>` (inclusive) and
    `next_<value>`, and returns the group profiles. A group with few distinct
    values is one window partition. Beyond, all groups are range-partitioned by
    (group, value) into as many ranges as their values ask for; each range sums
    on its own, in a task of its own, and starts from the totals of its group's
    ranges before it, of which there is one row per range.

    Without `profiles` the counts are computed once, kept, and profiled; that
    suits counts much smaller than the rows behind them. Given profiles need
    `distinct`; an upper bound will do.
    """
    if profiles is None:
        counts = materialise(counts)
        profiles = group_profiles(counts, group, value, sums)
    largest = max((p["distinct"] for p in profiles.values()), default=0)
    if largest <= plain_rows:
        window = Window.partitionBy(group).orderBy(value)
        result = counts.select(
            "*",
            *[F.sum(s).over(window).alias(f"upto_{s}") for s in sums],
            F.lead(value).over(window).alias(f"next_{value}"),
        )
        return result, profiles

    total = sum(p["distinct"] for p in profiles.values())
    ranges = ranges_for(total)
    # Kept, so that a value's range is the same wherever it is asked for.
    ranged = materialise(
        counts.repartitionByRange(ranges, group, value).withColumn("_range", F.spark_partition_id())
    )
    order = Window.partitionBy(group).orderBy("_range")
    starts = (
        ranged.groupBy(group, "_range")
        .agg(F.min(value).alias("_first"), *[F.sum(s).alias(f"_{s}") for s in sums])
        .select(
            group,
            "_range",
            *[(F.sum(f"_{s}").over(order) - F.col(f"_{s}")).alias(f"_before_{s}") for s in sums],
            F.lead("_first").over(order).alias("_next"),
        )
    )
    window = Window.partitionBy(group, "_range").orderBy(value)
    # A range is a task; left to the window's own exchange, ranges would be merged into a few tasks.
    spread = ranged.repartitionById(ranges, "_range")
    result = spread.join(F.broadcast(starts), [group, "_range"]).select(
        *counts.columns,
        *[(F.sum(s).over(window) + F.col(f"_before_{s}")).alias(f"upto_{s}") for s in sums],
        F.coalesce(F.lead(value).over(window), "_next").alias(f"next_{value}"),
    )
    return result, profiles
