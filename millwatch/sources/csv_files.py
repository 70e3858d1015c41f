"""Headered CSV under the column contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch import schema as S
from millwatch.operators import quality

# Texts that mean "no value" in the source files.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, named by the header; a UTF-8 BOM is dropped.

    No schema is imposed, since that would hide a wrong header from the contract;
    files whose headers differ from the first one fail.
    """
    return (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("enforceSchema", False)
        .option("encoding", "UTF-8")
        .csv(path)
    )


def typed(contract: DataFrame) -> DataFrame:
    """Contract columns with their types; flags stay 0/1 until they are validated.

    A text that is no value of its type becomes NULL, which validation reports.
    Numbers may stand among spaces; texts are kept as they are, so that a padded
    one breaks its rule.
    """
    columns = []
    for field in S.READINGS_SCHEMA.fields:
        text = F.col(field.name) if field.dataType.simpleString() == "string" else F.trim(F.col(field.name))
        value = F.when(~text.isin(*NULL_TOKENS), text)
        # A flag may be written 1 or 1.0; half a flag must reach validation as it is.
        target = "double" if field.name in S.FLAGS else field.dataType.simpleString()
        columns.append((value if target == "string" else value.try_cast(target)).alias(field.name))
    return contract.select(*columns)


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """Scan, contract and types: a batch ready for `quality.validate_batch`."""
    return typed(quality.column_contract(read_raw(spark, path)))


def write_raw(readings: DataFrame, path: str) -> None:
    """Readings as source CSV: contract headers, flags as 0/1."""
    columns = [
        (F.col(name).cast("int") if name in S.FLAGS else F.col(name)).alias(header)
        for header, name in S.CSV_COLUMNS.items()
    ]
    readings.select(*columns).write.mode("overwrite").option("header", True).csv(path)
