"""The digest tree of two tables against a plain comparison of their rows."""

from collections import Counter

import pytest

from millwatch.operators import table_diff

LEFT = [(k, f"v{k % 7}", k / 8) for k in range(300)] + [(None, "null key", 1.0), (5, "copy", None), (5, "copy", None)]
RIGHT = [(k, "changed" if k == 17 else f"v{k % 7}", k / 8) for k in range(1, 301)] + [(None, "null key", 2.0), (5, "copy", None)]
SCHEMA = "k long, v string, x double"


def plain(left, right):
    a, b = Counter(left), Counter(right)
    found = {}
    for n, rows in enumerate((a - b, b - a)):
        for row, times in rows.items():
            found.setdefault(row[0], [0, 0])[n] += times
    return {k: tuple(n) for k, n in found.items()}


def seal(spark, folder, name, rows, depth=2):
    table_diff.seal(spark.createDataFrame(rows, SCHEMA).repartition(3), ["k"], f"{folder}/{name}", depth)
    return f"{folder}/{name}"


def test_differing_rows_are_named_and_other_buckets_not_read(spark, folder):
    roots = seal(spark, folder, "a", LEFT), seal(spark, folder, "b", RIGHT)
    found = table_diff.differing_rows(spark, *roots, ["k"])
    wanted = plain(LEFT, RIGHT)
    assert {r["k"]: (r["n_left_only"], r["n_right_only"]) for r in found.collect()} == wanted
    assert set(wanted) == {0, 17, 300, 5, None}
    levels, buckets = table_diff.descend(spark, *roots)
    assert levels[0] == (0, 1, 1) and len(buckets) == levels[-1][2] <= len(wanted) and levels[2][1] <= 16 * levels[1][2]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(bucket" in plan and "PartitionFilters: [part" in plan


def test_equal_and_empty_tables(spark, folder):
    """Equal rows in another order need one comparison; an empty table has no node."""
    a, b = seal(spark, folder, "a", LEFT), seal(spark, folder, "b", LEFT[::-1])
    assert table_diff.descend(spark, a, b) == ([(0, 1, 0)], [])
    assert table_diff.differing_rows(spark, a, b, ["k"]).count() == 0
    none, empty = seal(spark, folder, "none", []), seal(spark, folder, "empty", [])
    assert table_diff.differing_rows(spark, none, empty, ["k"]).count() == 0
    found = table_diff.differing_rows(spark, a, none, ["k"]).collect()
    assert {r["k"]: (r["n_left_only"], r["n_right_only"]) for r in found} == plain(LEFT, [])


def test_trees_of_other_depths_are_refused(spark, folder):
    a, b = seal(spark, folder, "a", LEFT[:9], 1), seal(spark, folder, "b", LEFT[:9], 2)
    with pytest.raises(ValueError, match="1 and 2 levels"):
        table_diff.descend(spark, a, b)
    with pytest.raises(ValueError, match="depth 0"):
        seal(spark, folder, "c", LEFT[:9], 0)
