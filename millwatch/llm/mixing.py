"""Mix sources to target weights by balanced sampling with the cube method.

Every document of a source has the same expected number of copies. Its whole
part is taken by all; the fraction is an inclusion probability. Blocks of
documents move their probabilities along the null space of two balancing
constraints, words and documents, until at most two stay undecided; those meet
in blocks of the next level. The last two of a source are landed with one exchange.
"""

from __future__ import annotations

import hashlib
import random
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwatch.llm import common
from millwatch.session import materialise

#: The weights, dealt to the sources in their order, and the most copies on average.
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
BLOCK = 4096
EPS = 1e-9


def words(column="text"):
    """Number of words; null and empty texts have none."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per source: source, n_docs, source_size, target.

    Targets share the sum of all sizes by weight. Sources whose share is over
    `most` times their size are met in the order of size per weight: each stops
    at its limit and the rest is shared on. The windows hold one row per source.
    """
    sources = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    )
    all_rows = Window.partitionBy(F.lit(0))
    before = all_rows.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    limit = F.lit(most) * F.col("source_size")
    shared = (
        ranked.withColumn("ratio", limit / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(all_rows) - F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weights"))
        .withColumn("capped", F.col("ratio") <= F.col("level"))
    )
    # once one source is not capped, no later one is
    final = F.min(F.when(~F.col("capped"), F.struct("ratio", "rank", "level"))).over(all_rows)
    target = F.when(final.isNull() | (F.struct("ratio", "rank") < F.struct(final["ratio"], final["rank"])), limit)
    return shared.select("source", "n_docs", "source_size", target.otherwise(F.col("weight") * final["level"]).alias("target"))


def _step(units, rng):
    """Move two or three units' probabilities along the null space until one is 0 or 1; False if nothing can move."""
    if len(units) == 3:
        (a, b, c) = (u[1] for u in units)
        direction = (c - b, a - c, b - a)  # orthogonal to the sizes and to ones
        if direction == (0, 0, 0):
            direction = (1, -1, 0)
    elif len(units) == 2 and units[0][1] == units[1][1]:
        direction = (1, -1)
    else:
        return False
    up = down = float("inf")
    for (_, _, p), d in zip(units, direction):
        if d > 0:
            up, down = min(up, (1 - p) / d), min(down, p / d)
        elif d < 0:
            up, down = min(up, p / -d), min(down, (1 - p) / -d)
    move = up if rng.random() * (up + down) < down else -down
    for u, d in zip(units, direction):
        u[2] += move * d
        if u[2] < EPS:
            u[2] = 0.0
        elif u[2] > 1 - EPS:
            u[2] = 1.0
    return True


def flight(sizes, probabilities, rng) -> list[float]:
    """Probabilities after the flight phase: 0 or 1 but for at most two. Sums of sizes and of ones are kept."""
    found = list(probabilities)
    open_units: list[list] = []
    for i, (size, p) in enumerate(zip(sizes, found)):
        if EPS < p < 1 - EPS:
            open_units.append([i, int(size), p])
        else:
            found[i] = float(p >= 0.5)
        while len(open_units) == 3:
            _step(open_units, rng)
            for u in open_units:
                found[u[0]] = u[2]
            open_units = [u for u in open_units if 0 < u[2] < 1]
    while len(open_units) == 2 and _step(open_units, rng):
        for u in open_units:
            found[u[0]] = u[2]
        open_units = [u for u in open_units if 0 < u[2] < 1]
    return found


def land(sizes, probabilities, before) -> list[float]:
    """Decide the last units and settle the words.

    The undecided take the choice that misses the words of `before`, the
    probabilities at the start, least, then the documents. What is still missed
    is made up by one exchange of a taken unit for one that is not, which leaves
    the number of documents alone; only units that were open may be exchanged.
    """
    found = list(probabilities)
    left = [i for i, p in enumerate(found) if 0 < p < 1]
    best = min(
        range(1 << len(left)),
        key=lambda bits: (
            abs(sum(((bits >> k & 1) - found[i]) * int(sizes[i]) for k, i in enumerate(left))),
            abs(sum((bits >> k & 1) - found[i] for k, i in enumerate(left))),
            bits,
        ),
    )
    for k, i in enumerate(left):
        found[i] = float(best >> k & 1)
    missed = sum((x - p) * int(n) for x, p, n in zip(found, before, sizes))
    units = [(int(n), i) for i, (n, p) in enumerate(zip(sizes, before)) if EPS < p < 1 - EPS]
    taken, free = ([u for u in units if found[u[1]] == x] for x in (1.0, 0.0))
    free.sort()
    choice = (abs(missed), -1, -1)
    for n, i in taken if free else ():
        k = bisect_left(free, (n - missed, -1))
        for m, j in free[max(0, k - 1) : k + 1]:
            choice = min(choice, (abs(missed - n + m), i, j))
    if choice[1] >= 0:
        found[choice[1]], found[choice[2]] = 0.0, 1.0
    return found


UNIT = "source string, source_size long, target double, doc_id long, mark long, size long, n_rows long, whole long, p double, block long, n_blocks long"


def allocate(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 42) -> DataFrame:
    """Copies per unit. `rows` has doc_id, mark, source, size; rows equal in all four are one unit.

    Returns source, source_size, target, doc_id, mark, size, n_rows, whole (copies
    of every row) and extra (rows of the unit that get one copy more).
    """
    rows = materialise(rows.select("doc_id", "mark", "source", "size"))
    shares = targets(rows, weights, most)
    units = rows.groupBy("doc_id", "mark", "source", "size").agg(F.count("*").alias("n_rows"))
    copies = F.least(F.lit(float(most)), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    n_blocks = F.ceil(F.col("n_docs") / F.lit(float(BLOCK))).cast("long")
    open_units = (
        units.alias("u").join(shares.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source"))).drop(F.col("s.source"))
        .withColumn("whole", F.floor(copies).cast("long"))
        .withColumn("p", (copies - F.col("whole")) * F.col("n_rows"))
        .withColumn("n_blocks", n_blocks)
        .withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "mark"), F.col("n_blocks")))
        .select([c.split()[0] for c in UNIT.split(", ")])
    )

    def decide(key, part):
        part = part.sort_values(["size", "doc_id", "mark"], ascending=[False, True, True], na_position="last", kind="stable")
        rng = random.Random(hashlib.sha256(repr((seed, None if pd.isna(key[0]) else key[0], int(key[1]), int(key[2]))).encode()).digest())
        base = [float(int(p + EPS)) for p in part["p"]]
        before, sizes = [max(0.0, a - b) for a, b in zip(part["p"], base)], part["size"].tolist()
        p = flight(sizes, before, rng)
        if part["n_blocks"].iloc[0] == 1:
            p = land(sizes, p, before)
        return part.assign(p=[a + b for a, b in zip(base, p)])

    done, level = [], open_units
    blocks = shares.agg(F.max(n_blocks)).first()[0] or 1
    while True:
        # "n_blocks" tells the levels apart, so draws of different levels are independent
        level = materialise(level.groupBy("source", "block", "n_blocks").applyInPandas(decide, UNIT))
        whole = F.col("p") == F.floor("p")
        done.append(level.filter(whole))
        if blocks == 1:
            break
        wide = F.lit(BLOCK // 2)
        level = level.filter(~whole).withColumn("block", F.floor(F.col("block") / wide)).withColumn(
            "n_blocks", F.ceil(F.col("n_blocks") / wide)
        )
        blocks = common.ceil_div(blocks, BLOCK // 2)
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.withColumn("extra", F.col("p").cast("long")).drop("p", "block", "n_blocks")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"),
        F.col("source").cast("string").alias("source"), words().alias("size"),
    )


def quotas(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row per row of `docs`.

    Null texts have size 0 and take no words; null sources are one source, the
    last; equal rows share what their unit gets; an empty table gives no row.
    Draws follow from ids, texts and `seed` only, so reruns agree.
    """
    unit = allocate(_rows(docs), weights, most, seed)
    each = unit.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    copies = F.col("whole") + F.when(F.col("row") <= F.col("extra"), 1).otherwise(0)
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 42) -> DataFrame:
    """The mixed documents: the rows of `docs`, each as often as its quota says."""
    unit = allocate(_rows(docs), weights, most, seed).select(
        F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.col("source").alias("s"), "n_rows", "whole", "extra"
    )
    rows, names = common.numbered(docs)
    rows = common.keyed(rows, names).withColumn("__source", F.col(names["source"]).cast("string"))
    joined = rows.join(
        unit, rows[common.DOC].eqNullSafe(unit["d"]) & (rows[common.MARK] == unit["m"]) & rows["__source"].eqNullSafe(unit["s"])
    )
    # equal rows are told apart by a number, so that as many as the unit says get one copy more
    number = F.row_number().over(Window.partitionBy("d", "m", "s").orderBy("n_rows"))
    single = joined.filter("n_rows = 1").withColumn("copies", F.col("whole") + F.col("extra"))
    several = joined.filter("n_rows > 1").withColumn("copies", F.col("whole") + F.when(number <= F.col("extra"), 1).otherwise(0))
    return (
        single.unionByName(several).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(*names.values()).toDF(*docs.columns)
    )
