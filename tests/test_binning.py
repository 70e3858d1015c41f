"""Bins shared by fits: exact edges, codes, one read of raw inputs, models that score raw rows."""

import bisect

import pytest
from pyspark.sql import functions as F

from millwatch import schema as S
from millwatch.operators import binning, models, splits
from millwatch.sources import bundles

SMALL = models.ModelSpec("forest", trees=4, depth=5, bins=16)


def plain_edges(values, bins):
    values = sorted(values)
    n = len(values)
    at = {values[-(-i * n // bins) - 1] for i in range(1, bins)} - {values[0]}
    rest = [v for v in values if v > values[0]]
    return tuple(sorted(at)) or ((rest[0],) if rest else (values[0],))


COLUMNS = {
    "even": [float(x) for x in range(97)],
    "tied": [1.0] * 60 + [2.0] * 30 + [3.0] * 7,
    "mostly_least": [0.0] * 95 + [5.0, 6.0],
    "constant": [4.5] * 97,
    "wide": [(-1.0) ** x * 10.0 ** (x % 300) for x in range(97)],
}


@pytest.mark.parametrize("plain_rows", [1, 200_000], ids=["ranges", "windows"])
@pytest.mark.parametrize("bins", [2, 4, 16, 200])
def test_edges_are_the_exact_quantiles(spark, bins, plain_rows):
    rows = spark.createDataFrame(list(zip(*COLUMNS.values())), ", ".join(f"{c} double" for c in COLUMNS)).repartition(5)
    found = binning.bin_edges(rows, bins, list(COLUMNS), plain_rows)
    assert dict(found.edges) == {c: plain_edges(v, bins) for c, v in COLUMNS.items()}
    coded = binning.binned(rows.withColumns({f"raw_{c}": F.col(c) for c in COLUMNS}), found)
    assert not set(COLUMNS) & set(coded.columns)
    for row in coded.collect():
        for c in COLUMNS:
            assert row[f"bin_{c}"] == bisect.bisect_right(found.edges[c], row[f"raw_{c}"])


def test_odd_input_is_refused(spark):
    rows = spark.createDataFrame([(1.0,), (None,)], "x double")
    with pytest.raises(ValueError, match="Two bins"):
        binning.bin_edges(rows, 1, ["x"])
    with pytest.raises(ValueError, match="No values to bin in .'x'."):
        binning.bin_edges(rows.where("x IS NULL"), 4, ["x"])
    bins = binning.bin_edges(rows.union(rows.selectExpr("x + 1")), 4, ["x"])
    assert [r[0] for r in binning.binned(rows, bins).collect()] == [0, None]
    with pytest.raises(Exception, match="NaN"):
        binning.binned(rows.select(F.lit(float("nan")).alias("x")), bins).collect()


@pytest.fixture(scope="module")
def shared(spark, sf_dir):
    from catalog import inputs as I

    training = splits.train_rows(I.training(spark, sf_dir))
    folded = splits.stratified_folds(training)
    return folded, *models.shared_table(folded, SMALL, ("udi", "fold"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fits_and_scores_read_no_raw_input(shared):
    folded, table, _ = shared
    assert "parquet" in plan_of(folded).lower()
    oof = models.out_of_fold(table, SMALL)
    assert "parquet" not in plan_of(oof).lower() and not set(S.NUMERIC_FEATURES) & set(table.columns)
    rows = oof.collect()
    assert set(oof.columns) == {"udi", "fold", "y", "proba"}
    assert sorted(r["udi"] for r in rows) == sorted(r["udi"] for r in folded.select("udi").collect())
    assert all(abs(sum(r["proba"]) - 1) < 1e-9 for r in rows)


@pytest.mark.parametrize("spec", [SMALL, models.ModelSpec("boosted", 2, 3, bins=16)], ids=["forest", "boosted"])
def test_a_model_on_bins_scores_raw_rows_and_survives_saving(spark, shared, folder, spec):
    folded, table, bins = shared
    model = models.fit(table, spec, bins)
    inputs = folded.select("udi", *S.FEATURES)
    raw = {r["udi"]: r["proba"] for r in models.score(model, inputs).select("udi", "proba").collect()}
    stages = model.stages[len(models.feature_stages(bins)):]
    assert raw == {r["udi"]: r["proba"] for r in models.score_vectors(stages, table).select("udi", "proba").collect()}
    bundles.save_model(model, folder, bundles.Signature.of(inputs.drop("udi"), models.score(model, inputs.drop("udi"))))
    loaded = bundles.load_scorer(spark, folder)(inputs)
    assert raw == {r["udi"]: r["proba"] for r in loaded.select("udi", "proba").collect()}
    with pytest.raises(Exception, match="(?i)null"):
        models.score(model, inputs.withColumn("torque_nm", F.lit(None).cast("double"))).collect()
    extreme = inputs.limit(1).withColumns({"torque_nm": F.lit(1e9), "air_temp_k": F.lit(-1e9)})
    assert abs(sum(models.score(model, extreme).first()["proba"]) - 1) < 1e-9


def test_equal_rows_give_equal_trees(shared):
    folded, table, bins = shared
    again, same = models.shared_table(folded.repartition(7, "torque_nm"), SMALL, ("udi", "fold"))
    assert same == bins

    def scores(t):
        return {r["udi"]: r["proba"] for r in models.score_vectors(models.fit_stages(t, SMALL), t).collect()}

    assert scores(again) == scores(table)
