"""Whether a fitted tree split where the data say it should.

The weighted Gini gain of every threshold of every input is worked out from
running sums over (node, input, value) and compared with the splits a tree
holds at its root and below. Nothing is fitted again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch import schema as S
from millwatch.operators import selection
from millwatch.session import materialise, scratch_path

INPUTS = ("type_code", *S.NUMERIC_FEATURES)
_WEIGHTS = [f"w{k}" for k in range(len(S.CLASSES))]


@dataclass(frozen=True)
class Split:
    """An inner node: rows that reach it meet `path`, those with `feature` <= `threshold` go left."""

    node: int
    level: int
    feature: str
    threshold: float
    gain: float
    path: tuple[tuple[str, bool, float], ...] = ()

    def reached(self) -> Column:
        met = F.lit(True)
        for feature, left, threshold in self.path:
            met &= (F.col(feature) <= threshold) if left else (F.col(feature) > threshold)
        return met


def splits_of(model: Transformer, rows: DataFrame, tree: int = 0, deepest: int = 1) -> list[Split]:
    """The inner nodes of one tree of a fitted forest down to a level, from the model as it is saved."""
    path = scratch_path(rows.sparkSession, "audited")
    model.write().save(path)
    nodes = rows.sparkSession.read.parquet(f"{path}/data").where(F.col("treeID") == tree)
    nodes = nodes.where(F.col("nodeData.leftChild") >= 0).select("nodeData.*")
    # a level has twice the nodes of the one above: few rows, however many the tree has
    found, asked = [], [(0, 0, ())]
    while asked:
        held = {r["id"]: r for r in nodes.where(F.col("id").isin([i for i, *_ in asked])).collect()}
        below = []
        for i, level, way in asked:
            if i not in held:
                continue  # a leaf
            r = held[i]
            feature, threshold = INPUTS[r["split"]["featureIndex"]], r["split"]["leftCategoriesOrThreshold"][0]
            found.append(Split(i, level, feature, threshold, r["gain"], way))
            if level < deepest:
                below += [(r["leftChild"], level + 1, (*way, (feature, True, threshold))), (r["rightChild"], level + 1, (*way, (feature, False, threshold)))]
        asked = below
    return found


def _gini(weights: Sequence[Column], total: Column) -> Column:
    return F.lit(1.0) - F.coalesce(F.try_divide(sum((w * w for w in weights[1:]), weights[0] * weights[0]), total * total), F.lit(0.0))


def split_gains(prepared: DataFrame, splits: Sequence[Split]) -> DataFrame:
    """node, feature, value, next_value, gain: every threshold that parts the rows of a node.

    Takes prepared rows (inputs, y, weight) and counts each distinct value once
    per node and class; the running sums are those of range-partitioned values,
    so no input of a node is brought to one task.
    """
    nodes = F.explode(F.filter(F.array(*[F.when(s.reached(), F.lit(s.node)) for s in splits]), lambda x: x.isNotNull()))
    long = prepared.select(nodes.alias("node"), "y", "weight", *[F.col(c).cast("double").alias(c) for c in INPUTS]).unpivot(
        ["node", "y", "weight"], list(INPUTS), "feature", "value"
    )
    counts = long.groupBy(F.concat_ws("/", "node", "feature").alias("part"), "value").agg(
        *[F.sum(F.when(F.col("y") == k, F.col("weight")).otherwise(0.0)).alias(w) for k, w in enumerate(_WEIGHTS)], F.count("*").alias("n_rows")
    )
    counts = materialise(counts)
    totals = counts.groupBy("part").agg(
        F.count("*").alias("distinct"), *[F.sum(w).alias(f"t{k}") for k, w in enumerate(_WEIGHTS)], F.sum("n_rows").alias("n")
    )  # one row per node and input
    profiles = {r["part"]: {"distinct": r["distinct"]} for r in totals.collect()}
    running, _ = selection.running_sums(counts, "part", "value", _WEIGHTS, profiles=profiles)
    left = [F.col(f"upto_{w}") for w in _WEIGHTS]
    right = [F.greatest(F.col(f"t{k}") - x, F.lit(0.0)) for k, x in enumerate(left)]
    whole = [F.col(f"t{k}") for k in range(len(_WEIGHTS))]
    add = lambda xs: sum(xs[1:], xs[0])
    gain = _gini(whole, add(whole)) - (add(left) * _gini(left, add(left)) + add(right) * _gini(right, add(right))) / add(whole)
    part = F.split("part", "/")
    return running.where(F.col("next_value").isNotNull()).join(F.broadcast(totals), "part").select(
        part[0].cast("int").alias("node"), part[1].alias("feature"), "value", "next_value", "n", gain.alias("gain")
    )


def audit(prepared: DataFrame, splits: Sequence[Split]) -> DataFrame:
    """node, level, n_rows, feature, threshold, stored_gain, gain, best_gain: one row per split.

    `gain` is worked out anew for the threshold that the tree holds, `best_gain`
    is the highest of any threshold of any input.
    """
    held = prepared.sparkSession.createDataFrame(
        [(s.node, s.level, s.feature, s.threshold, s.gain) for s in splits],
        "held_node int, level int, held_feature string, threshold double, stored_gain double",
    )
    gains = split_gains(prepared, splits).join(F.broadcast(held), F.col("node") == F.col("held_node"))
    here = (F.col("feature") == F.col("held_feature")) & (F.col("value") <= F.col("threshold")) & (F.col("threshold") < F.col("next_value"))
    return gains.groupBy("node", "level", F.col("held_feature").alias("feature"), "threshold", "stored_gain").agg(
        F.max("n").alias("n_rows"), F.max(F.when(here, F.col("gain"))).alias("gain"), F.max("gain").alias("best_gain")
    )
