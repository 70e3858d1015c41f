"""Saved models: a PipelineModel, its signature and JSON notes next to it."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from millwatch.operators import models
from millwatch.session import path_exists


class SignatureError(ValueError):
    """A table that a saved model was not trained on."""


@dataclass(frozen=True)
class Signature:
    """Names and types of a model's inputs and of what scoring adds to them."""

    inputs: dict[str, str]
    outputs: dict[str, str]

    @classmethod
    def of(cls, inputs: DataFrame, scored: DataFrame) -> Signature:
        given = dict(inputs.dtypes)
        return cls(given, {name: kind for name, kind in scored.dtypes if name not in given})

    def require(self, table: DataFrame) -> None:
        """Every input by its name and type, or one error that names all that differ; other columns may stand beside them.

        Reads the schema only, so no job runs for a table that does not fit.
        """
        names = [name for name, _ in table.dtypes]
        held = dict(table.dtypes)
        faults = [f"add {name} ({kind})" for name, kind in self.inputs.items() if name not in held]
        faults += [f"cast {name} from {held[name]} to {kind}" for name, kind in self.inputs.items() if held.get(name, kind) != kind]
        faults += [f"keep one of the columns {name}" for name in self.inputs if names.count(name) > 1]
        faults += [f"rename {name}, which scoring adds" for name in self.outputs if name in held]
        if faults:
            raise SignatureError("The table does not fit the saved model: " + "; ".join(faults))


def write_notes(spark: SparkSession, root: str, name: str, notes: dict) -> None:
    row = spark.createDataFrame([(json.dumps(notes, sort_keys=True),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(f"{root}/{name}")


def read_notes(spark: SparkSession, root: str, name: str) -> dict:
    return json.loads(spark.read.text(f"{root}/{name}").first()["value"])


def save_model(model: PipelineModel, root: str, signature: Signature, spark: SparkSession | None = None) -> None:
    """The model and its signature, model last: a folder with a model has a signature."""
    spark = spark or SparkSession.active()
    write_notes(spark, root, "signature", {"inputs": signature.inputs, "outputs": signature.outputs})
    model.write().overwrite().save(f"{root}/model")


def load_model(root: str) -> PipelineModel:
    """The exact saved model; nothing is fitted again."""
    return PipelineModel.load(f"{root}/model")


def load_signature(spark: SparkSession, root: str) -> Signature:
    if not has_notes(spark, root, "signature"):
        raise SignatureError(f"{root} holds no signature; save the model again with the schema of its inputs")
    return Signature(**read_notes(spark, root, "signature"))


def load_scorer(spark: SparkSession, root: str) -> Callable[[DataFrame], DataFrame]:
    """What scores tables with the saved model.

    A model that takes other inputs or gives other outputs than its signature
    says is refused here, a table that does not fit when it is given, both
    before any of its rows is read.
    """
    signature, model = load_signature(spark, root), load_model(root)
    empty = spark.createDataFrame([], ", ".join(f"`{name}` {kind}" for name, kind in signature.inputs.items()))
    found = Signature.of(empty, models.score(model, empty))
    if found != signature:
        raise SignatureError(f"The saved model gives {found.outputs}, its signature says {signature.outputs}; restore both from one run")

    def scorer(table: DataFrame) -> DataFrame:
        signature.require(table)
        return models.score(model, table)

    return scorer


def has_notes(spark: SparkSession, root: str, name: str) -> bool:
    return path_exists(spark, f"{root}/{name}/_SUCCESS")
