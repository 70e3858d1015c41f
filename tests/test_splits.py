import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millwatch import schema as S
from millwatch.operators import splits

FULL = {"no_failure": 9661, "TWF": 46, "HDF": 106, "PWF": 94, "OSF": 84}


@pytest.fixture(scope="module")
def labelled(spark):
    n = F.col("id")
    label = F.when(n < 40, "TWF").when(n < 130, "HDF").when(n < 137, "OSF").otherwise("no_failure")
    return spark.range(1003).select(n.alias("udi"), label.alias("failure_type"))


def test_quotas_on_the_published_class_counts():
    n_train = 9991 - math.ceil(0.2 * 9991)
    assert n_train == 7992
    train = splits.proportional(FULL, n_train)
    assert list(train.values()) == [7728, 37, 85, 75, 67]
    assert [n - train[name] for name, n in FULL.items()] == [1933, 9, 21, 19, 17]


def test_dealt_quotas_equal_dealing_one_by_one():
    counts = {"no_failure": 13, "TWF": 7, "HDF": 1, "OSF": 11}
    ordered = [name for name, n in counts.items() for _ in range(n)]
    expected = Counter((name, pos % 5) for pos, name in enumerate(ordered))
    quotas = splits.dealt(counts, 5)
    assert {(n, f): q for n, qs in quotas.items() for f, q in enumerate(qs) if q} == expected


def test_split_is_exact_disjoint_and_independent_of_partitioning(labelled):
    first = {r["udi"]: r["split"] for r in splits.stratified_split(labelled).collect()}
    again = splits.stratified_split(labelled.repartition(13, F.rand(5)), rank_rows=2)
    assert first == {r["udi"]: r["split"] for r in again.collect()}
    assert Counter(first.values()) == {"train": 802, "test": 201}
    other = {r["udi"]: r["split"] for r in splits.stratified_split(labelled, seed=43).collect()}
    assert other != first


def test_folds_cover_every_row_once_and_keep_class_shares(labelled):
    rows = splits.stratified_folds(labelled).collect()
    assert len({r["udi"] for r in rows}) == 1003
    sizes = Counter(r["fold"] for r in rows)
    assert sorted(sizes) == [0, 1, 2, 3, 4] and max(sizes.values()) - min(sizes.values()) <= 1
    per_class = Counter((r["failure_type"], r["fold"]) for r in rows)
    for name in ("TWF", "HDF", "OSF", "no_failure"):
        shares = [per_class[(name, f)] for f in range(5)]
        assert max(shares) - min(shares) <= 1


def test_cuts_survive_saving(labelled):
    cuts = splits.split_cuts(labelled)
    restored = splits.QuotaCuts.from_dict(cuts.to_dict())
    left = cuts.assign(labelled, "split")
    assert left.exceptAll(restored.assign(labelled, "split")).count() == 0


def test_unknown_labels_are_rejected(spark):
    df = spark.createDataFrame([(1, "no_failure"), (2, "RNF")], "udi long, failure_type string")
    with pytest.raises(ValueError, match="outside the five classes.*RNF"):
        splits.split_cuts(df)


def test_train_rows_never_hold_test_rows(labelled):
    train = {r["udi"] for r in splits.train_rows(labelled).collect()}
    split = splits.stratified_split(labelled)
    assert train == {r["udi"] for r in split.where("split = 'train'").collect()}
    assert S.TEST_FRACTION == 0.2
