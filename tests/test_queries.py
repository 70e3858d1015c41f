"""Every registered query against its SQL oracle, and the golden values."""

import sys
from dataclasses import replace

import pytest

import __spark_entry__ as driver
import compare
from catalog import inputs, oracles, queries
from millwatch.operators import drift, models, risk

QUERIES, ORACLES = dict(queries.QUERIES), dict(oracles.ORACLES)
ROWS_ONLY = {"forest_model", "boosted_model", "batch_score"}


@pytest.fixture(scope="module")
def oracle(sf_dir):
    return compare.oracle_connection(sf_dir)


def test_only_model_scores_lack_an_oracle():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", ["ahocorasick", "millwatch.llm", "corpus_pipeline"])
def test_sensor_queries_stand_without_the_corpus_part(monkeypatch, name):
    """Neither a missing part nor a missing library of it takes the other queries along."""
    for held in [m for m in sys.modules if m.startswith(("millwatch.llm", "corpus_pipeline", "catalog_"))]:
        monkeypatch.delitem(sys.modules, held)
    monkeypatch.setitem(sys.modules, name, None)
    if name == "ahocorasick":
        for module in ("tiktoken", "zstandard", "xxhash", "public_tokenizers"):
            monkeypatch.setitem(sys.modules, module, None)
        with pytest.warns(UserWarning, match="left out"):
            found = driver.queries()
    else:
        found = driver.queries()
    assert set(found) == set(QUERIES) and set(driver.oracle_sql()) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, sf_dir, oracle, name):
    assert compare.compare(QUERIES[name](spark, sf_dir), oracle, ORACLES[name]) is None


def test_batch_scores_are_shares_of_the_held_out_rows(spark, sf_dir):
    rows = QUERIES["batch_score"](spark, sf_dir).collect()
    test = QUERIES["stratified_split"](spark, sf_dir).where("split = 'test'")
    assert sorted(r["udi"] for r in rows) == sorted(r["udi"] for r in test.collect())
    for row in rows:
        shares = list(row)[1:]
        assert len(shares) == 5 and all(0 <= p <= 1 for p in shares) and abs(sum(shares) - 1) < 1e-9


def test_a_refit_depends_on_rows_and_seed_only(spark, sf_dir):
    train, test = queries._holdout(spark, sf_dir)
    spec = models.ModelSpec("forest", trees=3, depth=6, bins=32)

    def scores(rows, spec):
        model = models.fit_training_rows(rows, spec)
        return {r["udi"]: r["proba"] for r in models.score(model, test).select("udi", "proba").collect()}

    first = scores(train, spec)
    assert scores(train.repartition(5, "torque_nm").orderBy("strain_min_nm"), spec) == first
    assert scores(train, replace(spec, seed=7)) != first


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).collect()


def test_entry_returns_its_two_windows(spark):
    rows = {r["scenario"]: r for r in driver.entry(spark).collect()}
    assert set(rows) == {"healthy", "fault"}
    assert {r["verdict"] for r in rows.values()} == {"insufficient_data"}


# Golden values of the tables derived from the given events at two scales
LABELS = {"0.001": (841, 5, 13, 119, 21, 1), "0.01": (8309, 80, 130, 1275, 201, 5)}
SCORES = {
    "healthy": (0.047944, 0.031993, 0.027365, 0.015151, 0.033539, 0.020507, 0.043777, 0.031918, 0.018269),
    "fault": (1.037449, 0.031993, 0.027365, 0.015151, 0.033539, 0.020507, 2.039677, 0.031918, 0.018269),
}
COLUMNS = (
    "air_temp_k", "process_temp_k", "rotational_speed_rpm", "torque_nm", "tool_wear_min",
    "power_w", "temp_diff_k", "strain_min_nm", "type",
)
GOLDEN = "/root/testdata/sf0.01"


@pytest.mark.parametrize("sf", LABELS)
def test_golden_label_counts(spark, sf):
    rows = QUERIES["label_counts"](spark, f"/root/testdata/sf{sf}").collect()
    names = ("no_failure", "TWF", "HDF", "PWF", "OSF", None)
    assert {r["failure_type"]: r["n_rows"] for r in rows} == dict(zip(names, LABELS[sf]))


@pytest.mark.parametrize(("scenario", "fault"), [("healthy", 0.0), ("fault", 2.0)])
def test_golden_drift_scores(spark, scenario, fault):
    verdicts = drift.drift_verdicts(
        inputs.reference_window(spark, GOLDEN), inputs.current_window(spark, GOLDEN, fault)
    ).collect()
    found = {r["column"]: round(r["score"], 6) for r in verdicts}
    assert found == dict(zip(COLUMNS, SCORES[scenario]))
    drifted = sorted(r["column"] for r in verdicts if r["drifted"])
    assert drifted == ([] if scenario == "healthy" else ["air_temp_k", "temp_diff_k"])


def test_golden_thresholds_and_tiers(spark):
    scored = inputs.scored(spark, GOLDEN)
    expected = {0.02: 0.33470568210429186, 0.05: 0.22902239934011914, 0.10: 0.13674210854813784}
    for budget, threshold in expected.items():
        assert risk.choose_threshold(scored, budget).threshold == threshold
    report = {r["risk_tier"]: tuple(r)[1:] for r in QUERIES["tier_report"](spark, GOLDEN).collect()}
    assert report == {
        "low": (7479, 0, 0, 0, 0), "elevated": (799, 3, 0, 0, 14), "high": (31, 77, 130, 1275, 187)
    }


def test_golden_upsert_counts(spark):
    rows = {r["action"]: r["n_rows"] for r in QUERIES["upsert_diff"](spark, GOLDEN).collect()}
    assert rows == {"insert": 1000, "update": 1286, "unchanged": 7714}


def test_reordered_formula_is_told_apart(spark):
    rows = {r["computation"]: r["n_left_only"] for r in QUERIES["parity_check"](spark, GOLDEN).collect()}
    assert rows["served"] == 0 and rows["reordered"] > 1000
    assert queries.QUERIES is not QUERIES
