import json

import pytest
from pyspark.sql import functions as F

import toys
from millwatch import schema as S
from millwatch.operators import quality

#: Values of a JSON type that a field does not take, by the kind of its column.
OF_ANOTHER_TYPE = {"float": ["warm", None, [7.5], False], "int": ["9", None, 3.25, 12.0, True, {"n": 1}]}
OUT_OF_RANGE = {"> 0": [("greater_than", -0.25), ("greater_than", 0)], ">= 0": [("greater_than_equal", -7)]}
#: Each input's kind and range, as its column type and its physical meaning have it.
RULES = {
    "air_temp_k": ("float", "> 0"), "process_temp_k": ("float", "> 0"), "rotational_speed_rpm": ("int", "> 0"),
    "torque_nm": ("float", ">= 0"), "tool_wear_min": ("int", ">= 0"),
}


def broken_bodies():
    """Every input with every rule it can break: (field, body, kind of error)."""
    for field in S.RAW_INPUTS:
        yield field, {k: v for k, v in toys.READING.items() if k != field}, "missing"
    for grade in ("l", "", "LM", 5, None):
        yield "type", {**toys.READING, "type": grade}, "literal_error"
    for field, (kind, bounds) in RULES.items():
        values = [(f"{kind}_type", v) for v in OF_ANOTHER_TYPE[kind]]
        values += [(error, int(v) if kind == "int" and int(v) == v else v) for error, v in OUT_OF_RANGE[bounds] if kind == "float" or int(v) == v]
        if kind == "int":
            values += [("int_parsing_size", 2**31), ("int_parsing_size", 7 * 10**15)]
        else:
            values += [("finite_number", sign * float(x)) for x in ("nan", "inf") for sign in (1, -1)]
        for error, value in values:
            yield field, {**toys.READING, field: value}, error
    for key in ("product_id", "machine_failure", "Type", "torque_nm "):
        yield key, {**toys.READING, key: 1}, "extra_forbidden"


def violations(spark, *bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    rows = quality.validate_readings(df).orderBy("id").collect()
    return [[(v["field"], v["type"]) for v in r["violations"]] for r in rows], rows


def test_each_broken_rule_is_named_with_its_field(spark):
    cases = list(broken_bodies())
    found, _ = violations(spark, *[json.dumps(body) for _, body, _ in cases])
    assert found == [[(field, error)] for field, _, error in cases]
    assert {field for field, *_ in cases} >= set(S.RAW_INPUTS) and len(cases) > 50


def test_valid_readings_keep_their_values(spark):
    whole = {**toys.READING, "air_temp_k": 298}
    found, rows = violations(spark, json.dumps(toys.READING), json.dumps(whole))
    assert found == [[], []]
    assert [rows[0][c] for c in S.RAW_INPUTS] == list(toys.READING.values())
    assert rows[1]["air_temp_k"] == 298.0


def test_several_faults_are_all_listed_in_order(spark):
    body = {**toys.READING, "type": "Q", "torque_nm": -2.0, "zeta": 1, "alpha": 2}
    good = json.dumps(toys.READING)
    found, _ = violations(
        spark, json.dumps(body), "no json", "[1]", "{}", None, "", good + " x", good[:-1],
        good.replace('"type"', '"torque_nm": 1.0, "type"'), good.replace('"', "'"),
    )
    assert found[0] == [
        ("type", "literal_error"), ("torque_nm", "greater_than_equal"),
        ("alpha", "extra_forbidden"), ("zeta", "extra_forbidden"),
    ]
    assert found[1] == found[2] == [("body", "json_invalid")]
    assert found[3] == [(field, "missing") for field in S.RAW_INPUTS]
    assert found[4:] == [[("body", "json_invalid")]] * 6


def test_column_contract_lists_both_mismatches(spark):
    df = spark.range(1).select(F.lit(1).alias("UDI"), F.lit(2).alias("Extra"))
    with pytest.raises(ValueError, match=r"add \[.*'Product ID'.*\], drop \['Extra'\]"):
        quality.column_contract(df)


def staged(spark, rows):
    return toys.readings_frame(spark, rows).withColumns({f: F.col(f).cast("int") for f in S.FLAGS})


def test_validation_collects_every_problem_before_failing(spark):
    batch = staged(spark, [(1, {}), (1, {"type": "X"}), (2, {"product_id": "SHORT"}), (3, {})])
    batch = batch.withColumn("hdf", F.when(F.col("udi") == 3, 2).otherwise(F.col("hdf")))
    batch = batch.withColumn("torque_nm", F.when(F.col("udi") != 2, F.col("torque_nm")))
    bad = {r["rule"]: r["n_bad"] for r in quality.validate_batch(batch).where("n_bad > 0").collect()}
    assert bad == {
        "udi_unique": 1, "type_domain": 1, "product_id_length": 1, "hdf_binary": 1,
        "torque_nm_null": 1,
    }
    with pytest.raises(ValueError) as error:
        quality.require_valid(batch)
    assert all(rule in str(error.value) for rule in bad)


def test_a_key_repeated_in_a_third_of_the_rows_is_counted_whole(spark):
    rows = staged(spark, [(1, {})])
    batch = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("udi"))
    batch = batch.crossJoin(rows.drop("udi"))
    bad = {r["rule"]: r["n_bad"] for r in quality.validate_batch(batch).where("n_bad > 0").collect()}
    assert bad == {"udi_unique": 999}


def test_valid_batch_converts_flags(spark):
    batch = staged(spark, [(1, {"twf": True})])
    quality.require_valid(batch)
    row = quality.flags_to_bool(batch).first()
    assert (row["twf"], row["hdf"]) == (True, False)


@pytest.mark.parametrize(
    ("change", "names"),
    [
        *[({c: v}, [f"predictions_log_{c}_check"]) for c, v in [
            ("model_version", 0), ("type", "X"), ("air_temp_k", 0.0), ("rotational_speed_rpm", 0),
            ("torque_nm", -1.0), ("tool_wear_min", -1), ("p_twf", 1.5), ("runner_up_mode", "RNF"),
            ("elevated_threshold", 1.5)]],
        ({"runner_up_mode": "no_failure"}, ["runner_up_differs"]),
        ({"predicted_mode": "TWF", "runner_up_mode": "no_failure"}, ["tier_matches_rule"]),
        ({"confidence_score": 0.8}, ["tier_matches_rule"]),
        ({"risk_tier": "elevated"}, ["tier_matches_rule"]),
        ({"confidence_score": 0.75, "risk_tier": "elevated"}, ["tier_matches_rule"]),
        ({"confidence_score": None}, ["confidence_score_not_null"]),
        ({}, []),
        ({"confidence_score": 0.8, "risk_tier": "elevated"}, []),
        ({"predicted_mode": "TWF", "runner_up_mode": "no_failure", "risk_tier": "high"}, []),
    ],
)
def test_each_constraint_by_name(spark, change, names):
    row = quality.annotate_log(toys.log_frame(spark, change)).first()
    assert row["violations"] == names


def test_modes_of_constraint_checks(spark):
    annotated = quality.annotate_log(toys.log_frame(spark, {}, {"p_hdf": -0.1}, {"p_hdf": 2.0}))
    good, bad = quality.quarantine(annotated)
    assert (good.count(), bad.count()) == (1, 2)
    counts = quality.violation_counts(annotated).collect()
    assert [tuple(r) for r in counts] == [("predictions_log_p_hdf_check", 2)]
    broken = quality.strict(toys.log_frame(spark, {}, {"p_hdf": 2.0}), quality.log_checks(), S.LOG_COLUMNS)
    with pytest.raises(Exception, match="predictions_log_p_hdf_check"):
        broken.collect()
    fine = quality.strict(toys.log_frame(spark, {}), quality.log_checks(), S.LOG_COLUMNS)
    assert fine.count() == 1 and fine.columns == list(S.LOG_COLUMNS)


def test_response_contradictions(spark):
    df = spark.createDataFrame(
        [(True, "high", "TWF", "HDF"), (False, "high", "TWF", "HDF"), (True, "high", "no_failure", "HDF"),
         (True, "elevated", "TWF", "HDF"), (False, "low", "no_failure", "no_failure"), (True, "odd", "no_failure", "RNF")],
        "flagged boolean, risk_tier string, predicted_mode string, runner_up_mode string",
    )
    shares = ("confidence_score", "predicted_probability", "runner_up_probability")
    df = df.withColumns({c: F.when(F.col("risk_tier") == "odd", -0.5).otherwise(0.5) for c in shares})
    found = [r["violations"] for r in quality.annotate(df, quality.response_checks()).collect()]
    assert found == [
        [], ["flagged_matches_tier"], ["high_matches_mode"], ["high_matches_mode"], ["runner_up_differs"],
        ["risk_tier_domain", "runner_up_mode_domain", *(f"{c}_range" for c in shares)],
    ]


def test_a_missing_value_breaks_its_domain_rule_too(spark):
    batch = staged(spark, [(1, {}), (2, {})])
    none = F.when(F.col("udi") == 2, None)
    batch = batch.withColumn("type", none.otherwise(F.col("type")))
    batch = batch.withColumn("twf", none.otherwise(F.col("twf")))
    bad = {r["rule"]: r["n_bad"] for r in quality.validate_batch(batch).where("n_bad > 0").collect()}
    assert bad == {"type_null": 1, "type_domain": 1, "twf_null": 1, "twf_binary": 1}
    keyless = batch.withColumn("udi", F.lit(None).cast("long"))
    bad = {r["rule"]: r["n_bad"] for r in quality.validate_batch(keyless).where("n_bad > 0").collect()}
    assert bad["udi_null"] == 2 and bad["udi_unique"] == 1
