import math

import pytest
from pyspark.sql import functions as F

from millwatch.operators import integrity
from millwatch.operators.reconcile import multiset_difference, require_reproduced

ROWS = [(1, "L", 40.0, 0), (2, "M", 50.0, 1), (3, "H", 60.0, 2)]
SCHEMA = "udi long, type string, torque_nm double, y int"


def digest(spark, rows):
    return integrity.fingerprint_hex(spark.createDataFrame(rows, SCHEMA))


def test_digest_is_stable_and_ignores_order_and_partitions(spark):
    base = digest(spark, ROWS)
    assert base == digest(spark, [ROWS[2], ROWS[0], ROWS[1]])
    assert len(base) == 64 and set(base) <= set("0123456789abcdef")
    many = spark.createDataFrame(ROWS * 50, SCHEMA)
    assert integrity.fingerprint_hex(many) == integrity.fingerprint_hex(many.repartition(7, F.rand(3)))


@pytest.mark.parametrize(
    "rows",
    [
        [ROWS[0], (2, "M", math.nextafter(50.0, math.inf), 1), ROWS[2]],
        [*ROWS[:2], (3, "H", 60.0, 3)],
        [*ROWS[:2], (4, "H", 60.0, 2)],
        ROWS[:2],
        [*ROWS, (4, "L", 45.0, 0)],
        [*ROWS, ROWS[2]],
        [*ROWS[:2], (3, None, 60.0, 2)],
        [*ROWS[:2], (3, "H", -60.0, 2)],
    ],
)
def test_any_change_changes_the_digest(spark, rows):
    assert digest(spark, rows) != digest(spark, ROWS)


def test_verification_names_both_digests(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    integrity.verify_fingerprint(df, integrity.fingerprint_hex(df))
    with pytest.raises(RuntimeError, match="not the rows sealed at training"):
        integrity.verify_fingerprint(df.limit(2), integrity.fingerprint_hex(df))


def test_multiset_difference_counts_copies(spark):
    left = spark.createDataFrame(ROWS + [ROWS[0]], SCHEMA)
    right = spark.createDataFrame(ROWS + [(9, "L", 1.0, 0)], SCHEMA)
    assert tuple(multiset_difference(left, right).first()) == (1, 1)
    assert tuple(multiset_difference(left, left).first()) == (0, 0)


def test_reproduction_names_the_cells(spark):
    one = spark.createDataFrame([("TWF", "HDF", 3)], "true string, predicted string, n_rows long")
    two = spark.createDataFrame([("TWF", "HDF", 4)], "true string, predicted string, n_rows long")
    require_reproduced(one, one, "r1")
    with pytest.raises(RuntimeError, match=r"r1.*TWF as HDF 3 times \(4 logged\)"):
        require_reproduced(one, two, "r1")
