"""Class-weighted tree models on the nine inputs.

A fitted model is a `PipelineModel`: grade code, vector assembly, and either one
random forest or rounds of boosting on the joint softmax loss. `score` turns
either into the same `proba` array, in class order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial, reduce
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch import schema as S
from millwatch.functions import classes
from millwatch.operators import audits, binning
from millwatch.session import materialise

_GRADE_SQL = (
    "SELECT *, CAST(CASE type "
    + " ".join(f"WHEN '{grade}' THEN {code}" for code, grade in enumerate(S.GRADES))
    + " ELSE raise_error(concat('Unknown grade: ', coalesce(type, 'NULL'))) END AS DOUBLE)"
    " AS type_code FROM __THIS__"
)
_WORKING = ("type_code", "features", "rawPrediction", "probability", "prediction", "margin")
#: Smallest curvature of a row, so that a certain row still has a step.
_LEAST_CURVATURE = 1e-16
#: Rounds of boosting after which the margins are written and the lineage cut.
_ROUNDS_IN_LINEAGE = 10


@dataclass(frozen=True)
class ModelSpec:
    """What to fit. The defaults are the full-size forest, as deep as Spark allows; see `boosted_spec` for boosting."""

    kind: str = "forest"
    trees: int = 300
    depth: int = 30
    learning_rate: float = 0.1
    l2: float = 1.0
    bins: int = 128
    bootstrap: bool = True
    seed: int = S.SEED
    parallelism: int = 5

    def __post_init__(self):
        if self.kind not in ("forest", "boosted"):
            raise ValueError(f"Unknown model kind {self.kind!r}; expected forest or boosted")


def boosted_spec(rounds: int = 300, depth: int = 6, seed: int = S.SEED) -> ModelSpec:
    return ModelSpec("boosted", rounds, depth, seed=seed)


def _vector(numeric: Sequence[str]) -> Transformer:
    return VectorAssembler(inputCols=["type_code", *numeric], outputCol="features")


def feature_stages(bins: binning.Bins | None = None) -> list[Transformer]:
    """Fixed stages: an ordinal grade code (a wrong grade fails) and the vector, of bins if there are any."""
    grade = SQLTransformer(statement=_GRADE_SQL)
    return [grade, _vector(S.NUMERIC_FEATURES)] if bins is None else [grade, bins.stage(), _vector(bins.columns)]


def _labelled(rows: DataFrame) -> DataFrame:
    """The label column tells Spark that there are five classes, so a part that
    lacks a class still gives five probabilities."""
    five = {"ml_attr": {"type": "nominal", "vals": list(S.CLASSES)}}
    return rows.withColumn("label", F.col("y").cast("double").alias("label", metadata=five))


def prepare(training: DataFrame, label: str = "failure_type") -> DataFrame:
    """Code, class weight and feature vector of labelled rows, ready for any fit."""
    weighted = audits.sample_weights(training, label).withColumn("y", classes.class_code(label))
    return reduce(lambda df, stage: stage.transform(df), feature_stages(), _labelled(weighted))


def shared_table(training: DataFrame, spec: ModelSpec, keep: Sequence[str] = ("udi",)) -> tuple[DataFrame, binning.Bins]:
    """Prepared rows whose vectors are bins, written once for all fits, and the bins.

    Held are the columns of `keep`, `y`, `weight` and one small number per input;
    vectors are put together when read. Rows lie in an order that follows from
    them alone, so equal rows, seed and cores grow equal trees.
    """
    bins = binning.bin_edges(training, spec.bins)
    weighted = audits.sample_weights(training).withColumn("y", classes.class_code("failure_type"))
    grade = feature_stages()[0]
    narrow = binning.binned(grade.transform(dealt(weighted)), bins)
    held = narrow.select(*keep, "y", "weight", F.col("type_code").cast("smallint").alias("type_code"), *bins.columns)
    return _vector(bins.columns).transform(_labelled(materialise(held))), bins


def _forest(prepared: DataFrame, spec: ModelSpec) -> list[Transformer]:
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", weightCol="weight",
        numTrees=spec.trees, maxDepth=spec.depth, maxBins=spec.bins, bootstrap=spec.bootstrap, seed=spec.seed,
    )
    return [forest.fit(prepared)]


Fitted = TypeVar("Fitted")


def fit_side_by_side(
    spark: SparkSession, fits: Sequence[Callable[[], Fitted]], parallelism: int
) -> list[Fitted]:
    """Independent fits at the same time: one fills the gaps between another's jobs."""
    if parallelism <= 1:
        return [run() for run in fits]
    with ThreadPool(min(parallelism, len(fits))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda run: run()), fits)


def softmax(margin: Column) -> Column:
    """Shares of an array of raw scores; the largest is taken off first, so none overflows."""
    parts = F.transform(margin, lambda m: F.exp(m - F.array_max(margin)))
    return F.transform(parts, lambda p: p / F.aggregate(parts, F.lit(0.0), lambda a, b: a + b))


def log_loss(proba: Column, y: Column) -> Column:
    """A row's share of the loss that boosting lowers."""
    return -F.log(F.greatest(F.element_at(proba, y + 1), F.lit(1e-300)))


def gradients(rows: DataFrame) -> DataFrame:
    """`rows` with g and h: slope and curvature of the weighted softmax loss in each class's raw score."""
    steps = lambda p: F.transform(p, lambda x, k: F.col("weight") * (x - (k == F.col("y")).cast("double")))
    bends = lambda p: F.transform(p, lambda x: F.col("weight") * F.greatest(2 * x * (1 - x), F.lit(_LEAST_CURVATURE)))
    return rows.withColumn("_p", softmax(F.col("margin"))).withColumns({"g": steps(F.col("_p")), "h": bends(F.col("_p"))}).drop("_p")


def _class_tree(rows: DataFrame, spec: ModelSpec, k: int) -> Transformer:
    """A regression tree of class k's Newton steps.

    Weighted by the curvature, the variance that a split takes off the steps is
    what it takes off the loss to second order.
    """
    tree = DecisionTreeRegressor(
        featuresCol="features", labelCol=f"step_{k}", weightCol=f"bend_{k}", predictionCol=f"mean_{k}", leafCol=f"leaf_{k}",
        maxDepth=spec.depth, maxBins=spec.bins, seed=spec.seed,
    )
    g, h = F.element_at("g", k + 1), F.element_at("h", k + 1)
    return tree.fit(rows.select("features", (-g / h).alias(f"step_{k}"), h.alias(f"bend_{k}")))


def leaf_sums(grown: DataFrame, n_classes: int) -> DataFrame:
    """k, leaf, g, h: sums over the rows in each leaf of each class's tree, in one pass."""
    each = F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"leaf_{k}").cast("int").alias("leaf"), F.element_at("g", k + 1).alias("g"), F.element_at("h", k + 1).alias("h"))
        for k in range(n_classes)
    ]))
    return grown.select(each.alias("x")).groupBy("x.k", "x.leaf").agg(F.sum("x.g").alias("g"), F.sum("x.h").alias("h"))


def _round_stages(rows: DataFrame, spec: ModelSpec) -> list[Transformer]:
    """Five trees on the current margins, and the step that adds their leaves to the margins."""
    n = len(S.CLASSES)
    fits = [partial(_class_tree, rows, spec, k) for k in range(n)]
    trees = fit_side_by_side(rows.sparkSession, fits, spec.parallelism)
    grown = reduce(lambda df, tree: tree.transform(df), trees, rows)
    leaves: list[dict[int, float]] = [{} for _ in range(n)]
    for k, leaf, g, h in leaf_sums(grown, n).collect():  # at most 2 ** depth a class
        leaves[k][leaf] = -spec.learning_rate * g / (h + spec.l2)
    steps = []
    for k, held in enumerate(leaves):
        values = ", ".join(f"{held.get(i, 0.0)!r}D" for i in range(max(held) + 1))
        steps.append(f"element_at(array({values}), CAST(leaf_{k} AS INT) + 1)")
    working = ", ".join(["margin", *[f"{name}_{k}" for name in ("mean", "leaf") for k in range(n)]])
    add = SQLTransformer(statement=f"SELECT * EXCEPT ({working}), zip_with(margin, array({', '.join(steps)}), (a, b) -> a + b) AS margin FROM __THIS__")
    return [*trees, add]


def _boosted(prepared: DataFrame, spec: ModelSpec) -> list[Transformer]:
    """Rounds of boosting on the softmax loss of all classes at once.

    All trees of a round see the same shares, so a round lowers the joint loss;
    leaf values are Newton steps with the penalty `l2`.
    """
    zero = SQLTransformer(statement=f"SELECT *, array({', '.join('0.0D' for _ in S.CLASSES)}) AS margin FROM __THIS__")
    stages: list[Transformer] = [zero]
    rows = zero.transform(prepared.select("features", "y", "weight"))
    held = None
    for number in range(1, spec.trees + 1):
        current = gradients(rows).persist(StorageLevel.MEMORY_AND_DISK)
        added = _round_stages(current, spec)
        stages += added
        if held is not None:
            held.unpersist()
        held = current
        rows = reduce(lambda df, stage: stage.transform(df), added, current.drop("g", "h"))
        if number % _ROUNDS_IN_LINEAGE == 0:
            rows = materialise(rows)
    if held is not None:
        held.unpersist()
    return stages


def staged(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """`rows` with `margins`, the raw scores of a boosted model before the first round and after each."""
    kept = [c for c in rows.columns if c not in ("margin", "margins")]
    out = rows.select(*kept, F.array().cast("array<array<double>>").alias("margins"))
    for stage in model.stages:
        out = stage.transform(out)
        if isinstance(stage, SQLTransformer) and "margin" in out.columns:
            out = out.withColumn("margins", F.concat("margins", F.array("margin")))
    return out.select(*kept, "margins")


def fit_stages(prepared: DataFrame, spec: ModelSpec) -> list[Transformer]:
    """What a fit learns from prepared rows, without the stages that prepare them."""
    return _forest(prepared, spec) if spec.kind == "forest" else _boosted(prepared, spec)


def fit(prepared: DataFrame, spec: ModelSpec, bins: binning.Bins | None = None) -> PipelineModel:
    """Fit on prepared rows, given the bins of their vectors if they have any. Weights act here
    only; scoring is unweighted and starts from raw inputs."""
    return PipelineModel(stages=[*feature_stages(bins), *fit_stages(prepared, spec)])


def dealt(prepared: DataFrame, rows_in_part: int = 1_000_000) -> DataFrame:
    """Prepared rows over all cores, in an order that follows from the rows alone.

    Trees draw their rows by partition and place, so with a fixed order the same
    rows, seed and cores grow the same trees, however the source was laid out.
    """
    by = [*S.FEATURES, "y"]
    cores = prepared.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, -(-prepared.count() // rows_in_part))
    return prepared.repartition(parts, *by).sortWithinPartitions(*by)


def fit_training_rows(training: DataFrame, spec: ModelSpec) -> PipelineModel:
    prepared = dealt(prepare(training)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return fit(prepared, spec)
    finally:
        prepared.unpersist()


def score(model: PipelineModel, inputs: DataFrame) -> DataFrame:
    """The input columns plus `proba`, five probabilities that sum to 1."""
    kept = [c for c in inputs.columns if c not in _WORKING]
    return _with_proba(model.transform(inputs.select(kept)), kept)


def _with_proba(out: DataFrame, kept: Sequence[str]) -> DataFrame:
    if "margin" in out.columns:
        return out.select(*kept, softmax(F.col("margin")).alias("proba"))
    return out.select(*kept, vector_to_array("probability").alias("proba"))


def score_vectors(stages: Sequence[Transformer], prepared: DataFrame) -> DataFrame:
    """`proba` of rows that are prepared already, raw or in bins as the fit had them."""
    kept = [c for c in prepared.columns if c not in (*_WORKING, "label", "weight") and not c.startswith(binning.bin_column(""))]
    return _with_proba(PipelineModel(stages=list(stages)).transform(prepared.select(*kept, "features")), kept)


def out_of_fold(folded: DataFrame, spec: ModelSpec, folds: int = S.CV_FOLDS) -> DataFrame:
    """Each prepared row scored by the model that did not see its fold.

    `folded` is prepared rows with `fold`. Every fit and every score reads it, so
    it is a shared table, or the caller keeps it in storage until the scores are
    written. Forests of several folds grow at once; boosted models already grow
    one tree per class at a time.
    """
    fits = [partial(fit_stages, folded.where(F.col("fold") != k), spec) for k in range(folds)]
    at_once = spec.parallelism if spec.kind == "forest" else 1
    fitted = fit_side_by_side(folded.sparkSession, fits, at_once)
    parts = [score_vectors(stages, folded.where(F.col("fold") == k)) for k, stages in enumerate(fitted)]
    return reduce(DataFrame.unionByName, parts)
