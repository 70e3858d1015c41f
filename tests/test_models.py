"""Boosting on the joint softmax loss, and the audit of tree splits."""

import math

import pytest
from pyspark.sql import functions as F

from millwatch import schema as S
from millwatch.operators import models, split_audit
from millwatch.sources import bundles


@pytest.fixture(scope="module")
def prepared(spark, sf_dir):
    from catalog import inputs as I

    return models.prepare(I.training(spark, sf_dir)).persist()


@pytest.fixture(scope="module")
def boosted(prepared):
    return models.fit(prepared, models.boosted_spec(rounds=4, depth=3))


def losses(model, prepared):
    rows = models.staged(model, prepared.select("udi", *S.FEATURES, "y", "weight"))
    each = rows.select("weight", "y", F.posexplode("margins").alias("round", "margin"))
    loss = F.sum(F.col("weight") * models.log_loss(models.softmax(F.col("margin")), F.col("y"))) / F.sum("weight")
    return [r[1] for r in each.groupBy("round").agg(loss).orderBy("round").collect()]


def test_shares_of_raw_scores(spark):
    row = spark.sql("SELECT array(1.0D, 2.0D, -1.0D) AS a, array(800.0D, 0.0D, 0.0D) AS b").select(
        models.softmax(F.col("a")).alias("a"), models.softmax(F.col("b")).alias("b")
    ).first()
    total = math.exp(1) + math.exp(2) + math.exp(-1)
    assert row["a"] == pytest.approx([math.exp(1) / total, math.exp(2) / total, math.exp(-1) / total])
    assert row["b"] == [1.0, 0.0, 0.0]


def test_gradients_are_slopes_of_the_loss(spark):
    rows = spark.sql("SELECT array(0.3D, -0.2D, 1.1D, 0.0D, 0.4D) AS margin, 2 AS y, 3.0D AS weight")
    found = models.gradients(rows).first()
    z = [0.3, -0.2, 1.1, 0.0, 0.4]

    def loss(z):
        return -3.0 * (z[2] - math.log(sum(map(math.exp, z))))

    for k in range(5):
        up, down = ([x + d * (i == k) for i, x in enumerate(z)] for d in (1e-5, -1e-5))
        assert found["g"][k] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6)
        p = math.exp(z[k]) / sum(map(math.exp, z))
        assert found["h"][k] == pytest.approx(3.0 * 2 * p * (1 - p))


def test_every_round_lowers_the_loss(boosted, prepared):
    found = losses(boosted, prepared)
    assert found[0] == pytest.approx(math.log(5)) and len(found) == 5
    assert all(b < a for a, b in zip(found, found[1:]))


def test_leaves_hold_newton_steps(spark, prepared):
    """One round of stumps: the rows on each side of the root move by -rate * G / (H + l2)."""
    spec = models.ModelSpec("boosted", trees=1, depth=1, learning_rate=0.5, l2=2.0)
    model = models.fit(prepared, spec)
    rows = models.staged(model, prepared.select("udi", *S.FEATURES, "y", "weight"))
    for k in range(5):
        groups = rows.select(
            F.element_at(F.element_at("margins", 2), k + 1).alias("value"), "weight", (F.col("y") == k).cast("double").alias("is")
        ).groupBy("value").agg(F.sum(F.col("weight") * (0.2 - F.col("is"))).alias("g"), (F.sum("weight") * 2 * 0.2 * 0.8).alias("h")).collect()
        assert 1 <= len(groups) <= 2
        for r in groups:
            assert r["value"] == pytest.approx(-0.5 * r["g"] / (r["h"] + 2.0), abs=1e-9)


def test_saved_model_scores_alike(spark, boosted, prepared, tmp_path):
    rows = prepared.select("udi", *S.FEATURES)
    inputs = rows.drop("udi")
    bundles.save_model(boosted, str(tmp_path), bundles.Signature.of(inputs, models.score(boosted, inputs)))
    wanted = {r["udi"]: r["proba"] for r in models.score(boosted, rows).collect()}
    found = {r["udi"]: r["proba"] for r in bundles.load_scorer(spark, str(tmp_path))(rows).collect()}
    assert found == wanted and all(sum(p) == pytest.approx(1) and len(p) == 5 for p in found.values())


def test_lineage_is_cut_in_long_runs(prepared, monkeypatch):
    monkeypatch.setattr(models, "_ROUNDS_IN_LINEAGE", 2)
    model = models.fit(prepared, models.boosted_spec(rounds=5, depth=1))
    assert len(model.stages) == 2 + 1 + 5 * 6
    found = losses(model, prepared)
    assert all(b < a for a, b in zip(found, found[1:]))


def test_a_missing_class_only_loses(prepared):
    """Its slope is positive in every row, so each round lowers its raw score everywhere."""
    rows = prepared.where(F.col("y") != 3)
    model = models.fit(rows, models.boosted_spec(rounds=2, depth=2))
    scores = models.staged(model, rows.select("udi", *S.FEATURES)).select(F.transform("margins", lambda m: F.element_at(m, 4)).alias("m"))
    assert scores.where((F.element_at("m", 2) >= 0) | (F.element_at("m", 3) >= F.element_at("m", 2))).count() == 0


def gini(weights):
    total = sum(weights)
    return 1 - sum(w * w for w in weights) / total**2 if total else 0


def brute_gains(rows):
    """(input, value) -> gain of the split after that value."""
    found = {}
    whole = [sum(r["weight"] for r in rows if r["y"] == k) for k in range(5)]
    for feature in split_audit.INPUTS:
        values = sorted({float(r[feature]) for r in rows})
        for v in values[:-1]:
            left = [sum(r["weight"] for r in rows if r["y"] == k and r[feature] <= v) for k in range(5)]
            right = [a - b for a, b in zip(whole, left)]
            found[feature, v] = gini(whole) - (sum(left) * gini(left) + sum(right) * gini(right)) / sum(whole)
    return found


@pytest.fixture(scope="module")
def tree(prepared):
    model = models.fit(prepared, models.ModelSpec("forest", trees=1, depth=3, bins=256, bootstrap=False))
    return split_audit.splits_of(model.stages[-1], prepared, deepest=1)


def test_gains_match_brute_force(prepared, tree):
    some = prepared.where("udi % 9 = 0")
    rows = some.select("y", "weight", *split_audit.INPUTS).collect()
    found = {(r["feature"], r["value"]): r["gain"] for r in split_audit.split_gains(some, tree[:1]).collect()}
    wanted = brute_gains(rows)
    assert found.keys() == wanted.keys()
    for key, gain in wanted.items():
        assert found[key] == pytest.approx(gain, abs=1e-9)


def test_a_fitted_tree_holds_the_gains_it_claims(prepared, tree):
    assert [s.level for s in tree] == [0, 1, 1]
    found = {r["node"]: r for r in split_audit.audit(prepared, tree).collect()}
    assert found[0]["n_rows"] == prepared.count() == sum(r["n_rows"] for r in found.values() if r["level"] == 1)
    for r in found.values():
        assert r["gain"] == pytest.approx(r["stored_gain"], abs=1e-9)
        assert 0.98 * r["best_gain"] <= r["gain"] <= r["best_gain"] + 1e-12


def test_a_drawn_sample_claims_other_gains(prepared):
    """With bootstrap rows the stored gain is that of the draw, which the audit shows."""
    model = models.fit(prepared, models.ModelSpec("forest", trees=1, depth=1, bins=256))
    r = split_audit.audit(prepared, split_audit.splits_of(model.stages[-1], prepared, deepest=0)).first()
    assert abs(r["gain"] - r["stored_gain"]) > 1e-9 and r["gain"] <= r["best_gain"]


def test_a_wrong_split_is_found_out(prepared, tree):
    worse = split_audit.Split(0, 0, "air_temp_k", 300.05, 0.2)
    r = split_audit.audit(prepared, [worse]).first()
    assert r["gain"] < 0.9 * r["best_gain"] and abs(r["gain"] - r["stored_gain"]) > 1e-3


@pytest.fixture(scope="module")
def saved(spark, boosted, prepared, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("signed"))
    inputs = prepared.select(*S.FEATURES)
    bundles.save_model(boosted, root, bundles.Signature.of(inputs, models.score(boosted, inputs)))
    return root


def jobs_run(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


@pytest.mark.parametrize(
    ("change", "says"),
    [
        (lambda t: t.drop("torque_nm"), r"add torque_nm \(double\)$"),
        (lambda t: t.withColumnRenamed("power_w", "Power_W"), r"add power_w \(double\)$"),
        (lambda t: t.withColumn("tool_wear_min", F.col("tool_wear_min").cast("string")), r"cast tool_wear_min from string to int$"),
        (lambda t: t.drop("type").withColumn("strain_min_nm", F.lit(1)), r"add type \(string\); cast strain_min_nm from int to double$"),
        (lambda t: t.withColumn("proba", F.lit(1)), r"rename proba, which scoring adds$"),
        (lambda t: t.select("*", F.lit(1.0).alias("air_temp_k")), r"keep one of the columns air_temp_k"),
    ],
    ids=["missing", "renamed", "retyped", "two faults", "output clash", "twice"],
)
def test_a_table_that_does_not_fit_is_refused_before_any_job(spark, saved, prepared, change, says):
    scorer = bundles.load_scorer(spark, saved)
    table = change(prepared.select("udi", *S.FEATURES))
    before = jobs_run(spark)
    with pytest.raises(bundles.SignatureError, match=says):
        scorer(table)
    assert jobs_run(spark) == before


def test_a_model_must_give_what_its_signature_says(spark, saved, boosted, tmp_path):
    held = bundles.load_signature(spark, saved)
    assert held.inputs["type"] == "string" and held.outputs == {"proba": "array<double>"} and list(held.inputs) != []
    bundles.save_model(boosted, str(tmp_path), bundles.Signature(held.inputs, {"proba": "array<float>"}))
    with pytest.raises(bundles.SignatureError, match="its signature says"):
        bundles.load_scorer(spark, str(tmp_path))


def test_a_model_without_a_signature_is_refused(spark, boosted, tmp_path):
    boosted.write().overwrite().save(f"{tmp_path}/model")
    with pytest.raises(bundles.SignatureError, match="holds no signature"):
        bundles.load_scorer(spark, str(tmp_path))
