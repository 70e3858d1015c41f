"""Vector tables, and a query set against all rows in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwatch.llm import common

ROWS, QUERIES = 16384, 2048


def vectors(embeddings: DataFrame, nonzero: bool) -> DataFrame:
    """vec_id, v, dim: rows that take part, one per vec_id.

    Left out: null ids, null and empty vectors, vectors with null or non-finite
    components and, if `nonzero`, zero vectors. Rows that repeat an id count once,
    by the smallest vector.
    """
    taken = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    kept = taken.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    )
    if nonzero:
        kept = kept.filter(F.exists("v", lambda x: x != 0))
    return kept.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def sample(rows: DataFrame, most: int) -> dict[int, np.ndarray]:
    """At most `most` vectors, those of the smallest id hashes, by their length."""
    found: dict[int, list] = {}
    for r in common.hashed_sample(rows, "vec_id", most).collect():
        found.setdefault(r["dim"], []).append(r["v"])
    return {dim: np.array(v, dtype=float) for dim, v in found.items()}


def matrix(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)


def in_blocks(rows: DataFrame, is_query: Column, search: Callable, score: str, rows_in_block: int = ROWS, queries_in_block: int = QUERIES) -> DataFrame:
    """(query_id, vec_id, score) of `search` for each block of queries and block of rows of one length.

    `search(ids, vectors, query_ids, query_vectors)` gives three arrays. Blocks
    are dealt by id hash, so equal vectors spread; a group holds about
    `rows_in_block` rows and `queries_in_block` queries however large the table.
    """
    n = rows.count()
    n_rows = max(1, common.ceil_div(n, rows_in_block))
    queries = rows.filter(is_query)
    n_queries = max(1, common.ceil_div(queries.count(), queries_in_block))
    mine = lambda k, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(k)).cast("int")
    left = rows.select("vec_id", "v", "dim", mine(n_rows, 11).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("q"))
    right = queries.select("vec_id", "v", "dim", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("r"), mine(n_queries, 13).alias("q"))
    kind = {"double": pa.float64(), "long": pa.int64()}[score]
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", kind)])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return schema.empty_table()
        ids, query_ids = (t.column("vec_id").to_numpy() for t in (a, b))
        found = search(ids, matrix(a), query_ids, matrix(b))
        return pa.Table.from_arrays([pa.array(x, type=f.type) for x, f in zip(found, schema)], schema=schema)

    key = ["dim", "r", "q"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, f"query_id long, vec_id long, score {score}")


def ranked(found: DataFrame, k: int, best: Column) -> DataFrame:
    """query_id, rank, vec_id, score: the k first of each query, ties to the smaller vec_id. A query has at most k rows from each block."""
    order = Window.partitionBy("query_id").orderBy(best, "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
