"""Helpers that several operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key columns of a text row. Rows that repeat both id and text are interchangeable.
DOC, MARK = "__doc", "__mark"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more) -> DataFrame:
    """Id, mark and text only; other columns, clashing names included, stay behind. Null texts become empty."""
    return docs.select(
        F.col("doc_id").cast("long").alias(DOC),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias(MARK),
        F.coalesce("text", F.lit("")).alias("text"),
        *more,
    )


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`docs` under neutral column names, so that its own can't clash, and the new name of each; toDF(*docs.columns) undoes it."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def keyed(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """`docs` of `numbered` with the key columns."""
    return docs.withColumns({
        DOC: F.col(names["doc_id"]).cast("long"), MARK: F.xxhash64(F.coalesce(names["text"], F.lit(""))),
    })


def same_document(left: DataFrame, right: DataFrame):
    """Join condition on the key; null ids meet each other."""
    return left[DOC].eqNullSafe(right[DOC]) & (left[MARK] == right[MARK])


def batches(rows, schema: pa.Schema, size: int = 20_000):
    """Arrow batches of at most `size` rows from an iterable of tuples."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def slices(parts, rows: int = 512):
    """The same rows in smaller batches, so that few texts at a time become Python strings."""
    for part in parts:
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)


def _batch(held, schema):
    columns = zip(*held)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(values), type=field.type) for values, field in zip(columns, schema)], schema=schema
    )


def ceil_div(n: int, d: int) -> int:
    return -(-n // d)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, compressed, whole after a lost executor."""
    from millwatch.session import scratch_path  # on the driver only: this module travels to workers by value

    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hashed_sample(df: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """The `most` rows of the smallest key hashes.

    A bound on the hash, set from the row count with room for chance, leaves a
    few rows more than wanted over all partitions, so the sort that follows is small.
    """
    share = min(1.0, (most + 8 * most**0.5 + 8) / max(1, df.count()))
    rank = F.xxhash64(F.lit(seed), F.col(key))
    if share < 1:
        df = df.filter(rank < int((2 * share - 1) * 2**63))
    return df.orderBy(rank, key).limit(most)
