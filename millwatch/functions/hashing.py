"""Seeded row hashes: the order used by splits, folds and resampled windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: str | int, id_column: str = "udi") -> Column:
    """A seeded pseudo-random order that does not depend on partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")))


def unit_draw(salt: str, id_column: str) -> Column:
    """A repeatable uniform draw in [0, 1) per row."""
    first = F.substring(F.md5(F.concat(F.lit(f"{salt}:"), F.col(id_column).cast("string"))), 1, 8)
    return F.conv(first, 16, 10).cast("double") / F.lit(4294967296.0)


def row_digest(*columns: str) -> Column:
    """SHA-256 of the typed values of a row; one changed bit changes it.

    The JSON text keeps NULLs, quotes strings, and prints a double so that two
    different doubles never print alike.
    """
    row = F.struct(*[F.col(c) for c in columns])
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)
