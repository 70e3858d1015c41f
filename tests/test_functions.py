import math

import pytest
from pyspark.sql import functions as F

import toys
from millwatch import schema as S
from millwatch.functions import classes, physics
from millwatch.operators import evaluation, projections

RAW = "type string, air_temp_k double, process_temp_k double, rotational_speed_rpm int, torque_nm double, tool_wear_min int"


def test_physics_features_by_hand(spark):
    rows = [("L", 300.0, 310.0, 1500, 40.0, 100), ("M", 301.5, 310.0, 1200, 60.0, 200)]
    out = projections.model_input(spark.createDataFrame(rows, RAW))
    assert out.columns == list(S.FEATURES)
    found = [(r.power_w, r.temp_diff_k, r.strain_min_nm) for r in out.collect()]
    assert found[0] == pytest.approx((2000 * math.pi, 10.0, 4000.0))
    assert found[1] == pytest.approx((2400 * math.pi, 8.5, 12000.0))


def test_missing_inputs_are_all_named(spark):
    df = spark.range(1).select(F.lit("L").alias("type"))
    with pytest.raises(ValueError, match="air_temp_k.*tool_wear_min"):
        projections.model_input(df)


def test_extra_columns_are_dropped_and_order_is_fixed(spark):
    df = spark.createDataFrame([(1, 2.0, "L", 300.0, 310.0, 1500, 40.0)],
                               "tool_wear_min int, junk double, type string, air_temp_k double, "
                               "process_temp_k double, rotational_speed_rpm int, torque_nm double")
    assert projections.model_input(df).columns == list(S.FEATURES)


@pytest.mark.parametrize(
    ("flags", "label"),
    [
        ({}, "no_failure"),
        ({"rnf": True}, "no_failure"),
        ({"machine_failure": True}, None),
        ({"machine_failure": True, "rnf": True}, None),
        ({"machine_failure": True, "hdf": True, "osf": True}, "OSF"),
        ({"machine_failure": True, "hdf": True, "pwf": True, "osf": True}, "PWF"),
        ({"machine_failure": True, "twf": True, "pwf": True}, "TWF"),
    ],
)
def test_label_priority(spark, flags, label):
    df = toys.readings_frame(spark, [(1, flags)])
    assert projections.feature_view(df).first()["failure_type"] == label


def test_unknown_grade_has_no_strain_limit(spark):
    df = spark.createDataFrame([("X", 99999.0), ("L", 11000.0), ("L", 11000.5)],
                               "type string, strain_min_nm double")
    assert [r[0] for r in df.select(physics.strain_rule()).collect()] == [None, False, True]


@pytest.mark.parametrize(
    ("proba", "expected"),
    [([0.1, 0.6, 0.2, 0.05, 0.05], ("TWF", "HDF")), ([0.4, 0.4, 0.1, 0.05, 0.05], ("no_failure", "TWF")),
     ([0.2] * 5, ("no_failure", "TWF")), ([0.0, 0.0, 0.0, 0.0, 1.0], ("OSF", "no_failure"))],
)
def test_top_two_takes_the_first_of_a_tie(spark, proba, expected):
    row = evaluation.top_two(toys.scored(spark, [0], [proba])).first()
    assert (row["predicted"], row["runner_up"]) == expected


def test_labels_round_trip(spark):
    df = spark.createDataFrame([(c,) for c in S.CLASSES], "failure_type string")
    rows = projections.decode_labels(projections.encode_labels(df)).collect()
    assert [(r["y"], r["label"]) for r in rows] == list(enumerate(S.CLASSES))


@pytest.mark.parametrize("label", ["RNF", None])
def test_unknown_label_fails_and_is_named(spark, label):
    df = spark.createDataFrame([(label,)], "failure_type string")
    with pytest.raises(Exception, match=f"Unknown class label: {label or 'NULL'}"):
        projections.encode_labels(df).collect()


def test_unknown_grade_fails(spark):
    df = spark.createDataFrame([("X",)], "type string")
    with pytest.raises(Exception, match="Unknown grade: X"):
        projections.encode_grade(df).collect()


def test_wrong_number_of_classes_fails(spark):
    df = spark.createDataFrame([([0.5, 0.5],)], "proba array<double>")
    with pytest.raises(Exception, match="needs one probability for each of 5"):
        df.select(classes.confidence("proba")).collect()
