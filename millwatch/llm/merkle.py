"""Merkle manifest of a table: one tree per source, their roots under one root, and proofs by a recursive query.

Digests are SHA-256 over the hex text of the digests below, three at a time.
Built levels are stored as node rows that name their parent, so a recursive
query can climb from every leaf at once: each step appends the siblings of
the run that holds the leaf's ancestor and folds the leaf's claimed digest.
All work is column expressions and SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwatch.llm import common
from millwatch.session import scratch_path

#: Digests in a run, and the fields of a leaf in order.
RUN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels built in one pass over groups of RUN ** HEIGHT digests.
HEIGHT = 6
#: Leaves of so many consecutive numbers meet a node's row together: a node high up has a row for each such block below it,
#: so that no key of a step's join holds more leaves, and all levels together have few rows more.
BLOCK = RUN**HEIGHT
#: A node's number is its level, shifted, and its place; levels of the tree over sources begin at TOP.
SHIFT, TOP = 56, 64


@dataclass(frozen=True)
class Manifest:
    """leaves: number, doc_id, leaf, base, then columns kept; nodes: node, block, parent, pos, children; trees: base, rank, n, subroot; root: hex.

    `number` is a leaf's place in the order of sources and ids, `base` that of
    its tree's first leaf. Digests in tables are binary; `children` joins those
    of a run. `start` is the node above a leaf and `start_pos` its place there.
    """

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: str | None


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    """A row's digest: each field's bytes counted and given, `-` for null."""
    return digest(F.concat(*[field(f) for f in fields]))


def ranked(rows: DataFrame, order: Sequence[str], name: str, to: str) -> DataFrame:
    """A stored copy of `rows` with each row's place in `order`, without bringing them to one task.

    Rows are range-partitioned, so a place is the row's place in its partition
    and the sizes of those before: one row per partition.
    """
    wide = (1 << 33) - 1
    placed = common.stored(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), name
    )
    part = F.shiftright("__at", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part.alias("__part")).count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    return (
        placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # one row per partition
        .withColumn(to, F.col("__before") + F.col("__at").bitwiseAND(F.lit(wide))).drop("__at", "__part", "__before")
    )


def _over(value: Column, by: int) -> Column:
    """Whole division, exact for places below 2 ** 53."""
    return ((value - F.pmod(value, F.lit(by))) / F.lit(by)).cast("long")


def _more(level: int) -> Column:
    """Whether a tree of n leaves has several nodes at a level."""
    return F.col("n") > RUN**level


def _levels(rows: DataFrame, level: int) -> DataFrame:
    """base, rank, n, block, digest, nodes: groups of BLOCK digests of one level, taken HEIGHT levels up.

    `digest` is the group's node at the last level, or its tree's root if that
    lies lower. `nodes` has level, at and the joined digests of each run.
    """
    held = rows.groupBy("base", "rank", "n", _over(F.col("at"), BLOCK).alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: hexed(x["digest"])).alias("d0")
    )
    for k in range(1, HEIGHT + 1):
        below, more = f"d{k - 1}", _more(level + k - 1)
        runs = F.transform(F.sequence(F.lit(1), F.size(below), F.lit(RUN)), lambda i: F.array_join(F.slice(below, i, RUN), ""))  # noqa: B023
        held = held.withColumn(f"runs{k}", F.when(more, runs)).withColumn(
            f"d{k}", F.when(more, F.transform(f"runs{k}", lambda r: F.sha2(r.cast("binary"), 256))).otherwise(F.col(below))
        )

    def nodes(k: int) -> Column:
        first = F.col("block") * RUN ** (HEIGHT - k)
        made = F.transform(f"runs{k}", lambda r, i: F.struct(F.lit(level + k).alias("level"), (first + i).alias("at"), F.unhex(r).alias("children")))
        return F.coalesce(made, F.array().cast("array<struct<level:int,at:bigint,children:binary>>"))

    return held.select("base", "rank", "n", "block", F.unhex(F.element_at(f"d{HEIGHT}", 1)).alias("digest"), F.concat(*[nodes(k) for k in range(1, HEIGHT + 1)]).alias("nodes"))


def _trees(rows: DataFrame, most: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, roots) of all trees of `rows` (base, rank, n, at, digest), the largest of `most` leaves: base, rank, n, level, at, children and base, rank, n, digest."""
    level, nodes, roots = 0, None, None
    while True:
        found = common.stored(_levels(rows, level), f"{name}-{level}")
        some = found.select("base", "rank", "n", F.explode("nodes").alias("x")).select("base", "rank", "n", "x.*")
        nodes = some if nodes is None else nodes.unionByName(some)
        level += HEIGHT
        done = found.filter(~_more(level)).select("base", "rank", "n", "digest")
        roots = done if roots is None else roots.unionByName(done)
        if RUN**level >= most:
            return nodes, roots
        rows = found.filter(_more(level)).select("base", "rank", "n", F.col("block").alias("at"), "digest")


def _bucketed(rows: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """A stored copy in buckets of `key`, so that a join on it in every step of the climb leaves these rows where they are.

    The catalog entry goes at once; the files stay in the shared folder.
    """
    spark, table = rows.sparkSession, f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, *key).write.format("parquet").bucketBy(n, *key).sortBy(*key).option("path", scratch_path(spark, name)).saveAsTable(table)
    stored = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return stored


def _spread(nodes: DataFrame) -> DataFrame:
    """A row of each node for each block of leaf numbers from `low` to `high`."""
    return nodes.withColumn("block", F.explode(F.sequence(_over(F.col("low"), BLOCK), _over(F.col("high"), BLOCK)))).drop("low", "high")


def _numbered(level: Column, place: Column) -> Column:
    return F.shiftleft(level.cast("long"), SHIFT) + place


def manifest(docs: DataFrame, keep: dict[str, Column] | None = None, fields: Sequence[str] = FIELDS, source: str = "source") -> Manifest:
    """Leaves, parent-linked nodes, trees and root of `docs`.

    Leaves of a source stand in the order of doc_id, null first, then of their
    digests; sources in the order of their bytes, null first. Null fields and
    empty texts differ. Rows that repeat each other are leaves of their own.
    Other columns take no part, but for expressions given in `keep`. An empty
    table has no root.
    """
    kept = keep or {}
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("__source"), leaf([F.col(f) for f in fields]).alias("leaf"),
        *[c.alias(n) for n, c in kept.items()], F.monotonically_increasing_id().alias("__row"),
    )
    # the row's number in the scan lets even a large group of equal rows be cut into ranges
    placed = ranked(common.stored(leaves, "merkle-leaves"), ["__source", "doc_id", "leaf", "__row"], "merkle-placed", "number")
    spans = placed.groupBy(F.col("__source").alias("__of")).agg(F.min("number").alias("base"), F.count("*").alias("n"))
    sources = ranked(spans, ["base"], "merkle-sources", "rank")
    most, n_trees = sources.agg(F.max("n"), F.count("*")).first()
    here = placed.join(sources, F.col("__source").eqNullSafe(F.col("__of"))).drop("__source", "__of").withColumn("at", F.col("number") - F.col("base"))
    nodes, roots = _trees(here.select("base", "rank", "n", "at", F.col("leaf").alias("digest")), most or 0, "merkle-levels")
    trees = common.stored(roots, "merkle-trees")
    top = trees.select(F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("rank"), F.lit(n_trees).cast("long").alias("n"), F.col("rank").alias("at"), "digest")
    top_nodes, top_roots = _trees(top, n_trees, "merkle-top")
    top_levels = [k for k in range(1, 64) if RUN ** (k - 1) < n_trees]
    reach = trees.select(
        "base", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), _over(F.col("rank"), RUN**k).alias("at")) for k in top_levels]))
        .alias("x")
    ).groupBy("x.level", "x.at").agg(F.min("base").alias("low"), F.max(F.col("base") + F.col("n") - 1).alias("high")) if top_levels else None
    root = top_roots.select(hexed(F.col("digest"))).first()

    level, at, rank = F.col("level"), F.col("at"), F.col("rank")
    over = (lambda x: x) if n_trees > 1 else (lambda x: F.lit(None).cast("long"))
    above, above_pos = over(_numbered(F.lit(TOP + 1), _over(rank, RUN))), over(F.pmod(rank, F.lit(RUN)))
    wide = F.pow(F.lit(RUN), level).cast("long")  # leaves below a node
    inner = wide < F.col("n")  # the level above has more than this node
    parent = F.when(inner, _numbered(level + 1, F.col("base") + _over(at, RUN)))
    linked = nodes.select(
        _numbered(level, F.col("base") + at).alias("node"), F.coalesce(parent, above).alias("parent"),
        F.when(inner, F.pmod(at, F.lit(RUN))).otherwise(above_pos).cast("int").alias("pos"), "children",
        (F.col("base") + at * wide).alias("low"), (F.col("base") + F.least((at + 1) * wide, F.col("n")) - 1).alias("high"),
    )
    if reach is not None:
        linked = linked.unionByName(top_nodes.join(reach, ["level", "at"]).select(
            _numbered(level + TOP, at).alias("node"), F.when(inner, _numbered(level + TOP + 1, _over(at, RUN))).alias("parent"),
            F.when(inner, F.pmod(at, F.lit(RUN))).cast("int").alias("pos"), "children", "low", "high",
        ))
    several = F.col("n") > 1
    start = here.select(
        "number", "doc_id", "leaf", "base", *kept,
        F.when(several, _numbered(F.lit(1), F.col("base") + _over(at, RUN))).otherwise(above).alias("start"),
        F.when(several, F.pmod(at, F.lit(RUN))).otherwise(above_pos).cast("int").alias("start_pos"),
    )
    return Manifest(
        start, _bucketed(_spread(linked), ("node", "block"), "merkle_nodes"), trees.select("base", "rank", "n", F.col("digest").alias("subroot")), root[0] if root else None
    )


#: One row per leaf and level. A level's siblings stay in its own row, so rows do not grow on the way up.
CLIMB = """
WITH RECURSIVE climb (number, step, node, pos, folded, siblings) MAX RECURSION LEVEL 200 AS (
    SELECT number, 0, start, start_pos, claimed, X'' FROM {leaves}
    UNION ALL
    SELECT c.number, c.step + 1, n.parent, n.pos,
           unhex(sha2(lower(hex(concat(substring(n.children, 1, 32 * c.pos), c.folded, substring(n.children, 32 * c.pos + 33)))), 256)),
           concat(substring(n.children, 1, 32 * c.pos), substring(n.children, 32 * c.pos + 33))
    FROM climb c JOIN {nodes} n ON n.node = c.node AND n.block = c.number DIV {block}
)
SELECT number, step, folded, siblings FROM climb LIMIT ALL
"""


def climbed(tree: Manifest, claimed: Column) -> DataFrame:
    """number, folded, proof: each leaf's claimed digest folded up to the root with the siblings stored, and those, joined from leaf to root.

    `claimed` is an expression over the leaves. All digests are binary.
    """
    leaves = tree.leaves.select("number", "start", "start_pos", claimed.alias("claimed"))
    steps = tree.nodes.sparkSession.sql(CLIMB, leaves=leaves, nodes=tree.nodes, block=BLOCK)
    path = F.array_sort(F.collect_list(F.struct("step", "siblings")))
    return steps.groupBy("number").agg(
        F.max_by("folded", "step").alias("folded"), F.aggregate(path, F.lit(b""), lambda held, x: F.concat(held, x["siblings"])).alias("proof")
    )


def audit(docs: DataFrame, tampered: Column, changed: Column, fields: Sequence[str] = FIELDS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, tampered: one row per row of `docs`.

    `tampered` tells whose text is replaced by `changed` before its leaf is
    folded with the original siblings; null counts as no. A row whose text stays
    equal verifies. Digests are lower-case hex.
    """
    is_tampered = F.coalesce(tampered, F.lit(False))
    now = F.when(is_tampered, leaf([changed if f == "text" else F.col(f) for f in fields]))
    tree = manifest(docs, {"now": now, "tampered": is_tampered}, fields)
    folded = climbed(tree, F.coalesce("now", "leaf"))
    rows = tree.leaves.join(tree.trees.select("base", "subroot"), "base").join(folded, "number")
    root = F.lit(tree.root)
    return rows.select(
        "doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), root.alias("root"),
        F.sha2(hexed(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), hexed(F.col("folded")).alias("folded_root"),
        (hexed(F.col("folded")) == root).alias("verified"), "tampered",
    )


def newline_audit(docs: DataFrame) -> DataFrame:
    """`audit` where line feeds go from the texts whose id's CRC-32 is even."""
    return audit(docs, F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", ""))
