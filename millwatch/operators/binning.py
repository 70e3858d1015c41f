"""Quantile bins of the numeric inputs, cut once and shared by every fit.

Trees only look at thresholds between bins. With the edges cut beforehand, the
rows are stored once as small whole numbers, and the folds and the final fit
read that table; none of them reads raw inputs or searches quantiles again.
Edges follow from inputs alone, never from labels or folds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch import schema as S
from millwatch.operators.drift import numeric_counts
from millwatch.operators.selection import RANK_ROWS, running_sums


def bin_column(column: str) -> str:
    return f"bin_{column}"


@dataclass(frozen=True)
class Bins:
    """Inner edges per column, ascending. A value's bin is the number of edges at or below it."""

    edges: Mapping[str, Sequence[float]]

    @property
    def columns(self) -> list[str]:
        return [bin_column(c) for c in self.edges]

    def stage(self) -> Transformer:
        """The step of a model that puts raw inputs into bins. NaN fails; null stays null, and the vector after it fails."""
        ends = float("inf")
        return Bucketizer(
            inputCols=list(self.edges), outputCols=self.columns, handleInvalid="error",
            splitsArray=[[-ends, *edges, ends] for edges in self.edges.values()],
        )


def bin_edges(
    rows: DataFrame, bins: int, columns: Sequence[str] = S.NUMERIC_FEATURES, plain_rows: int = RANK_ROWS
) -> Bins:
    """Edges at the exact i/bins quantiles of each column, ties merged, so a bin may be missing.

    What is ordered are distinct values, in ranges that grow with them; at most
    bins - 1 edges a column reach the driver. A column with one value has one edge.
    """
    if bins < 2:
        raise ValueError(f"Two bins are the fewest, got {bins}")
    counts = numeric_counts(rows, columns).groupBy("column", "value").agg(F.sum("n").alias("n"))
    running, profiles = running_sums(counts, "column", "value", ["n"], plain_rows=plain_rows)
    if set(profiles) != set(columns):
        raise ValueError(f"No values to bin in {sorted(set(columns) - set(profiles))}")
    total = F.create_map(*[F.lit(x) for c in columns for x in (c, profiles[c]["total_n"])])[F.col("column")]
    ranked = running.withColumn("total", total)

    def quantiles_up_to(rank: Column) -> Column:
        """How many of the bins - 1 quantiles lie within the first `rank` rows."""
        return F.least(F.call_function("div", rank * F.lit(bins), F.col("total")), F.lit(bins - 1))

    first = F.col("upto_n") == F.col("n")
    alone = F.col("n") == F.col("total")
    holds = quantiles_up_to(F.col("upto_n")) > quantiles_up_to(F.col("upto_n") - F.col("n"))
    found = ranked.where(alone | (holds & ~first)).select("column", "value").collect()
    edges = {c: tuple(sorted(r["value"] for r in found if r["column"] == c)) for c in columns}
    lowest = [c for c in columns if not edges[c]]
    if lowest:  # more than (bins - 1) / bins of the rows hold the smallest value
        second = ranked.where(F.col("column").isin(lowest) & ~first).groupBy("column").agg(F.min("value").alias("value"))
        edges |= {r["column"]: (r["value"],) for r in second.collect()}
    return Bins(edges)


def binned(rows: DataFrame, bins: Bins) -> DataFrame:
    """`rows` with a small whole number per binned column in place of its raw value."""
    coded = bins.stage().transform(rows)
    return coded.withColumns({c: F.col(c).cast("smallint") for c in bins.columns}).drop(*bins.edges)
