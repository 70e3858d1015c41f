"""Stratified holdout and folds.

Quotas are exact; rows are taken in a seeded hash order, so the split does not
depend on partitioning. The only thing computed ahead is the hash at which each
quota ends in each class: a handful of cut keys. Assigning a row is then a
projection, without a shuffle or a per-class sort, and the same cut keys rebuild
the same split later.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch import schema as S
from millwatch.functions.hashing import order_key
from millwatch.operators.selection import RANK_ROWS, at_or_before, rank_cuts


@dataclass(frozen=True)
class QuotaCuts:
    """Where each part of each class ends in the seeded order."""

    seed: str
    parts: tuple[str, ...]
    label: str
    id_column: str
    quotas: dict[str, list[int]]
    cuts: dict[str, list[list]] = field(default_factory=dict)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, saved: dict) -> QuotaCuts:
        return cls(**{**saved, "parts": tuple(saved["parts"])})

    def part(self) -> Column:
        """The part of a row, needing a `_h` column with the order key."""
        chosen = F
        for name in self.quotas:
            ends = [tuple(cut) for cut in self.cuts[name]]
            part = F.lit(self.parts[-1])
            for position in reversed(range(len(self.parts) - 1)):
                end = ends[position]
                before = at_or_before("_h", self.id_column, end) if end[0] else F.lit(False)
                part = F.when(before, self.parts[position]).otherwise(part)
            chosen = chosen.when(F.col(self.label) == name, part)
        return chosen

    def assign(self, df: DataFrame, out: str) -> DataFrame:
        keyed = df.withColumn("_h", order_key(self.seed, self.id_column))
        return keyed.withColumn(out, self.part()).drop("_h")


def class_counts(df: DataFrame, label: str) -> dict[str, int]:
    """Rows per class, in class order; an unknown label is an error.

    At most one row per class and one for all unknown labels reach the driver.
    """
    known = F.when(F.col(label).isin(*S.CLASSES), F.col(label))
    rows = df.groupBy(known.alias("class")).agg(F.count("*").alias("n"), F.min(label).alias("example"))
    counted = {r["class"]: (r["n"], r["example"]) for r in rows.collect()}
    if None in counted:
        n, example = counted[None]
        raise ValueError(
            f"{n} rows carry a label outside the five classes, for example {example!r}; relabel or drop them ({', '.join(S.CLASSES)})"
        )
    return {name: counted[name][0] for name in S.CLASSES if name in counted}


def proportional(counts: dict[str, int], wanted: int) -> dict[str, int]:
    """Shares of `wanted` rows per class: floors, then the largest remainders."""
    total = sum(counts.values())
    exact = {name: (wanted * n) // total for name, n in counts.items()}
    remainders = sorted(
        counts, key=lambda name: (-((wanted * counts[name]) % total), S.CLASSES.index(name))
    )
    for name in remainders[: wanted - sum(exact.values())]:
        exact[name] += 1
    return exact


def dealt(counts: dict[str, int], folds: int) -> dict[str, list[int]]:
    """Rows of each class per fold when the class-sorted rows are dealt round robin."""
    quotas, start = {}, 0
    for name, n in counts.items():
        quotas[name] = [
            (start + n - fold + folds - 1) // folds - (start - fold + folds - 1) // folds
            for fold in range(folds)
        ]
        start += n
    return quotas


def quota_cuts(
    df: DataFrame,
    seed: str | int,
    parts: Sequence[str],
    quotas: dict[str, list[int]],
    label: str = "failure_type",
    id_column: str = "udi",
    rank_rows: int = RANK_ROWS,
) -> QuotaCuts:
    """Find the cut keys for the given quotas (parts in order, one list per class)."""
    keyed = df.select(label, id_column, order_key(seed, id_column).alias("_h"))
    ends = {
        name: [sum(shares[: i + 1]) for i in range(len(parts) - 1)]
        for name, shares in quotas.items()
    }
    found = rank_cuts(
        keyed, label, "_h", id_column,
        {name: sorted({k for k in ks if k > 0}) for name, ks in ends.items()},
        rank_rows,
    )
    cuts = {}
    for name, ks in ends.items():
        at = dict(zip(sorted({k for k in ks if k > 0}), found[name]))
        cuts[name] = [list(at[k]) if k > 0 else ["", 0] for k in ks]
    return QuotaCuts(str(seed), tuple(parts), label, id_column, quotas, cuts)


def split_cuts(
    labelled: DataFrame,
    test_fraction: float = S.TEST_FRACTION,
    seed: str | int = S.SEED,
    label: str = "failure_type",
    id_column: str = "udi",
    rank_rows: int = RANK_ROWS,
) -> QuotaCuts:
    """Cut keys of the stratified train/test holdout."""
    counts = class_counts(labelled, label)
    total = sum(counts.values())
    n_train = total - math.ceil(test_fraction * total)
    train = proportional(counts, n_train)
    quotas = {name: [train[name], n - train[name]] for name, n in counts.items()}
    return quota_cuts(labelled, seed, ("train", "test"), quotas, label, id_column, rank_rows)


def stratified_split(labelled: DataFrame, **options) -> DataFrame:
    """Labelled rows with `split` in train, test."""
    return split_cuts(labelled, **options).assign(labelled, "split")


def fold_cuts(
    training: DataFrame,
    folds: int = S.CV_FOLDS,
    seed: str | int = S.SEED,
    label: str = "failure_type",
    id_column: str = "udi",
    rank_rows: int = RANK_ROWS,
) -> QuotaCuts:
    """Cut keys of the shuffled stratified folds, in another order than the holdout."""
    quotas = dealt(class_counts(training, label), folds)
    names = tuple(str(fold) for fold in range(folds))
    return quota_cuts(training, f"fold-{seed}", names, quotas, label, id_column, rank_rows)


def stratified_folds(training: DataFrame, **options) -> DataFrame:
    """Training rows with an integer `fold`."""
    assigned = fold_cuts(training, **options).assign(training, "fold")
    return assigned.withColumn("fold", F.col("fold").cast("int"))


def train_rows(labelled: DataFrame, cuts: QuotaCuts | None = None) -> DataFrame:
    """The training part only; held-out rows never become a reference."""
    cuts = cuts or split_cuts(labelled)
    return cuts.assign(labelled, "split").where(F.col("split") == "train").drop("split")
