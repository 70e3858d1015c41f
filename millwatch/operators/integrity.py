"""Fingerprint of a row set.

Every row gets a SHA-256; the digests are added up in four 64-bit lanes and the
sums, with the row count, are hashed once more. Sums do not depend on order or
partitioning and combine on the map side, so no rows are shuffled or collected,
at any size. Copies count: a row held twice is not the row held once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch import schema as S
from millwatch.functions.hashing import row_digest


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One row (n_rows, fingerprint) over the named columns, or over all of them."""
    digest = rows.select(row_digest(*(columns or rows.columns)).alias("d"))
    lanes = {
        f"lane{i}": F.sum(
            F.conv(F.substring("d", 16 * i + 1, 16), 16, 10).cast("decimal(28,0)")
        )
        for i in range(4)
    }
    sums = digest.agg(F.count("*").alias("n_rows"), *[s.alias(name) for name, s in lanes.items()])
    text = F.concat_ws(":", "n_rows", *[F.coalesce(F.col(n), F.lit(0)).cast("string") for n in lanes])
    return sums.select("n_rows", F.sha2(text, 256).alias("fingerprint"))


def fingerprint_hex(rows: DataFrame, *columns: str) -> str:
    return fingerprint(rows, *columns).first()["fingerprint"]


def verify_fingerprint(rows: DataFrame, expected: str, *columns: str) -> None:
    """Fail unless the rows are the ones the fingerprint was taken of."""
    actual = fingerprint_hex(rows, *columns)
    if actual != expected:
        raise RuntimeError(f"These are not the rows sealed at training (then {expected}, now {actual}); restore them or train again")


def sealed_columns(id_column: str = "udi") -> tuple[str, ...]:
    return (id_column, *S.FEATURES, "failure_type")


