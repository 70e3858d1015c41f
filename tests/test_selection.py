"""The narrowing operators against sorting everything."""

import random

import pytest
from pyspark.sql import functions as F

from millwatch.operators import selection
from millwatch.operators.selection import kth_largest, rank_cuts, running_sums


@pytest.mark.parametrize("shape", ["uniform", "third_tied", "all_tied", "clustered"])
def test_kth_largest_equals_a_full_sort(spark, shape):
    rng = random.Random(7)
    values = {
        "uniform": [rng.random() for _ in range(3000)],
        "third_tied": [0.25] * 1000 + [rng.random() for _ in range(2000)],
        "all_tied": [0.5] * 500,
        "clustered": [1e-9 * rng.random() for _ in range(2000)] + [1e6, -1e6],
    }[shape]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    ordered = sorted(values, reverse=True)
    for k in (0, 1, len(values) // 3, len(values) // 2, len(values) - 1):
        assert kth_largest(df, "x", k, fanout=8, rank_rows=3) == ordered[k]
    with pytest.raises(ValueError, match="outside"):
        kth_largest(df, "x", len(values))


@pytest.mark.parametrize("rank_rows", [1, 100_000])
def test_rank_cuts_equal_a_full_sort(spark, rank_rows):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("s"),
        F.md5((F.col("id") % 700).cast("string")).alias("h"),  # equal hashes too
        F.col("id").alias("i"),
    )
    expected = {}
    for s in "ab":
        keys = sorted((r["h"], r["i"]) for r in df.where(F.col("s") == s).collect())
        expected[s] = keys
    ranks = {"a": [1, 2, 300, 667], "b": [10, 1333]}
    found = rank_cuts(df.repartition(6), "s", "h", "i", ranks, rank_rows)
    assert found == {s: [expected[s][k - 1] for k in ks] for s, ks in ranks.items()}
    with pytest.raises(ValueError, match="fewer than"):
        rank_cuts(df, "s", "h", "i", {"a": [668]}, rank_rows)


@pytest.mark.parametrize("plain_rows", [0, 100_000])
def test_running_sums_equal_a_full_sort(spark, plain_rows):
    rng = random.Random(3)
    rows = [(g, float(v), rng.randint(0, 5), rng.randint(0, 5))
            for g in ("p", "q") for v in rng.sample(range(-500, 500), 400)]
    rows += [("single", 1.5, 2, 3)]
    df = spark.createDataFrame(rows, "g string, v double, a int, b int").repartition(4)
    out, profiles = running_sums(df, "g", "v", ["a", "b"], plain_rows=plain_rows)
    expected = []
    for g in ("p", "q", "single"):
        mine = sorted(r for r in rows if r[0] == g)
        a = b = 0
        for i, r in enumerate(mine):
            a, b = a + r[2], b + r[3]
            expected.append((g, r[1], a, b, mine[i + 1][1] if i + 1 < len(mine) else None))
        assert profiles[g]["total_a"] == a
        assert profiles[g]["distinct"] == len(mine)
    found = [tuple(r) for r in out.select("g", "v", "upto_a", "upto_b", "next_v").collect()]
    assert sorted(found) == sorted(expected)


def test_ranges_grow_with_the_values(spark, monkeypatch):
    """Ranges of a few values each, a value that a third of the rows share, groups of unequal size."""
    monkeypatch.setattr(selection, "RANGE_ROWS", 3)
    rng = random.Random(8)
    rows = [(g, 7.0 if rng.random() < 0.33 else round(rng.gauss(0, 40), 1)) for g in range(3) for _ in range((900, 40, 1)[g])]
    counts = spark.createDataFrame(rows, "g int, x double").groupBy("g", "x").agg(F.count("*").alias("n"))
    running, _ = running_sums(counts, "g", "x", ["n"], plain_rows=0)
    found = {(r["g"], r["x"]): (r["upto_n"], r["next_x"]) for r in running.collect()}
    for g, x in set(rows):
        larger = [v for h, v in rows if h == g and v > x]
        assert found[g, x] == (sum(h == g and v <= x for h, v in rows), min(larger, default=None))
    plan = running._jdf.queryExecution().toString()
    assert "percentile" not in plan and len(found) == len(set(rows))


def test_a_range_stays_a_task(spark, monkeypatch):
    """Running sums of many values are not gathered again in the few tasks of a session's shuffles."""
    monkeypatch.setattr(selection, "RANGE_ROWS", 50)
    counts = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"), F.lit(1).alias("n"))
    running, _ = running_sums(counts, "g", "x", ["n"], plain_rows=100)
    right = running.where("upto_n = (x - g) / 2 + 1")
    sizes = [r["count"] for r in right.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(sizes) == 5000 and len(sizes) > 64 and max(sizes) <= 250
