"""Which rows of two large tables differ, by a tree of additive row digests.

Sealing a table writes one digest per row, ordered by the beginning of its key's
hash, and the sums of those digests for every prefix up to the root. Two
sealed tables are compared from the root down: only children of nodes that
differ are looked at, and only the digests in leaf buckets that differ are read
and joined. Equal tables cost one comparison of two rows, at any size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch.functions.hashing import row_digest

_LANES = tuple(f"lane{i}" for i in range(4))
TREE = "level int, prefix string, n_rows long, " + ", ".join(f"{lane} decimal(38,0)" for lane in _LANES)


def _lane(i: int) -> Column:
    return F.conv(F.substring("digest", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")


def seal(rows: DataFrame, key: Sequence[str], root: str, depth: int = 2) -> None:
    """Write `digests` (key, digest, bucket, n) and `tree` (level, prefix, n_rows, lanes) below `root`.

    There are 16 ** depth buckets. Null keys are keys; copies count, and are kept
    as one digest and a number.
    """
    if depth < 1:
        raise ValueError(f"A tree has one level below its root or more, got depth {depth}")
    columns = sorted(rows.columns)
    digests = rows.select(*key, row_digest(*columns).alias("digest"), F.substring(row_digest(*key), 1, depth).alias("bucket"))
    # copies collapse on the map side; ranges of digests split a bucket that is large, and small ones share a file
    counted = digests.groupBy(*key, "digest", "bucket").agg(F.count("*").alias("n")).withColumn("part", _part(F.col("bucket")))
    ordered = counted.repartitionByRange("bucket", "digest").sortWithinPartitions("part", "bucket")
    ordered.write.mode("overwrite").partitionBy("part").parquet(f"{root}/digests")
    rows.select(*key).limit(0).write.mode("overwrite").parquet(f"{root}/keys")
    level = _digests(rows.sparkSession, root).groupBy(F.col("bucket").alias("prefix")).agg(
        F.sum("n").alias("n_rows"), *[F.sum(_lane(i) * F.col("n")).cast("decimal(38,0)").alias(lane) for i, lane in enumerate(_LANES)]
    )
    # at most 16 ** depth rows: every higher level is summed from the leaves
    each = level.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn(
        "prefix", F.expr("substring(prefix, 1, level)")
    )
    tree = each.groupBy("level", "prefix").agg(
        F.sum("n_rows").alias("n_rows"), *[F.sum(lane).cast("decimal(38,0)").alias(lane) for lane in _LANES]
    )
    tree.coalesce(1).write.mode("overwrite").parquet(f"{root}/tree")


def _part(bucket: Column) -> Column:
    """The folder of a bucket, one of 16; inside, files are sorted by bucket, so row groups of others are skipped."""
    return F.substring(bucket, 1, 1)


def _digests(spark: SparkSession, root: str) -> DataFrame:
    """The stored digests; `keys`, a table without rows, says of what type a key is, also where there is none."""
    schema = spark.read.parquet(f"{root}/keys").schema.add("digest", "string").add("bucket", "string").add("n", "long").add("part", "string")
    return spark.read.schema(schema).parquet(f"{root}/digests")


def _nodes(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(TREE).parquet(f"{root}/tree")


def descend(spark: SparkSession, left: str, right: str) -> tuple[list[tuple[int, int, int]], list[str]]:
    """((level, nodes compared, nodes that differ) per level, leaf buckets that differ).

    The driver holds prefixes of nodes, at most 16 ** depth, never rows.
    """
    sides = [_nodes(spark, root) for root in (left, right)]
    depths = [side.agg(F.max("level")).first()[0] for side in sides]
    if None not in depths and depths[0] != depths[1]:
        raise ValueError(f"The tables were sealed {depths[0]} and {depths[1]} levels deep; seal both alike")
    depth = max((d for d in depths if d is not None), default=-1)
    seen, open_nodes = [], [""]
    for level in range(depth + 1):
        parent = F.expr(f"substring(prefix, 1, {max(level - 1, 0)})")
        wanted = [side.where((F.col("level") == level) & parent.isin(open_nodes)) for side in sides]
        a, b = (w.select("prefix", F.struct("n_rows", *_LANES).alias(name)) for w, name in zip(wanted, "ab"))
        met = a.join(b, "prefix", "full_outer").select("prefix", (~F.col("a").eqNullSafe(F.col("b"))).alias("differs")).collect()
        open_nodes = sorted(r["prefix"] for r in met if r["differs"])
        seen.append((level, len(met), len(open_nodes)))
        if not open_nodes:
            return seen, []
    return seen, open_nodes


def differing_rows(spark: SparkSession, left: str, right: str, key: Sequence[str]) -> DataFrame:
    """(key, n_left_only, n_right_only) of every key whose rows differ, duplicates counted.

    Reads the digests of differing buckets: folders are pruned, then row groups. A
    key on one side has 0 on the other, a changed row counts on both.
    """
    _, buckets = descend(spark, left, right)
    sides = []
    for root, mark in ((left, 1), (right, -1)):
        rows = _digests(spark, root).where(F.col("part").isin(sorted({b[:1] for b in buckets})) & F.col("bucket").isin(buckets))
        sides.append(rows.select(*key, "digest", (F.lit(mark) * F.col("n")).alias("_net")))
    net = reduce(DataFrame.unionByName, sides).groupBy(*key, "digest").agg(F.sum("_net").alias("_net")).where("_net <> 0")
    return net.groupBy(*key).agg(
        F.sum(F.greatest("_net", F.lit(0))).alias("n_left_only"), F.sum(F.greatest(-F.col("_net"), F.lit(0))).alias("n_right_only")
    )
