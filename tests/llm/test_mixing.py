import random

import corpus
import pytest

from millwatch.llm import mixing


def plain_targets(sizes):
    """Share by weight, stop at three times a size, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def frame(spark, data):
    return corpus.table(spark, data)


def count(text):
    return len((text or "").encode().split())


def test_targets_totals_and_reruns(spark):
    rng = random.Random(5)
    data = [(i, corpus.words(rng, rng.randint(0, 400)), None, rng.choice(["a", "b", "b", "b", "é", "", None, "z"]), None) for i in range(900)]
    data += [data[3], data[3], (None, "one two", None, "a", None), (901, None, None, "a", None)]
    found = mixing.quotas(frame(spark, data)).collect()
    assert sorted((repr(r["doc_id"]), r["size"]) for r in found) == sorted((repr(d), count(t)) for d, t, *_ in data)
    sizes = {}
    for _, t, _, s, _ in data:
        sizes[s] = sizes.get(s, 0) + count(t)
    wanted = plain_targets(sizes)
    by_target = {}
    for r in found:
        by_target.setdefault((r["source_size"], r["target"]), []).append(r)
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    assert sorted((sizes[s], pytest.approx(wanted[s])) for s in sizes) == sorted(by_target)
    for (_, target), rows in by_target.items():
        assert abs(sum(r["taken"] for r in rows) - target) <= 0.01 * target + 5
    again = mixing.quotas(frame(spark, data).repartition(7)).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, map(tuple, again)))


def test_levels_of_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    data = [(i, "w " * (i % 50), None, "a" if i % 3 else "b", None) for i in range(800)]
    found = mixing.quotas(frame(spark, data)).collect()
    assert len(found) == len(data)
    for target in {r["target"] for r in found}:
        rows = [r for r in found if r["target"] == target]
        assert abs(sum(r["taken"] for r in rows) - target) <= 50
        copies = [r["copies"] for r in rows]
        assert max(copies) - min(copies) <= 1


def test_flight_keeps_both_sums():
    rng = random.Random(2)
    sizes = [rng.randint(1, 500) for _ in range(400)]
    p = [rng.random() for _ in sizes]
    found = mixing.flight(sizes, p, rng)
    assert sum(0 < x < 1 for x in found) <= 2
    assert sum(found) == pytest.approx(sum(p)) and sum(a * b for a, b in zip(found, sizes)) == pytest.approx(sum(a * b for a, b in zip(p, sizes)))
    assert all(x in (0.0, 1.0) for x in mixing.land(sizes, found, p))
    assert mixing.flight([], [], rng) == []


def test_flight_draws_with_the_given_probabilities():
    sizes = [9, 7, 7, 5, 4, 3, 3, 3, 2, 2, 1, 1]
    taken = [0.0] * len(sizes)
    for seed in range(3000):
        for i, x in enumerate(mixing.flight(sizes, [0.4] * len(sizes), random.Random(seed))):
            taken[i] += x
    assert all(abs(t / 3000 - 0.4) < 0.04 for t in taken)


def test_landing_settles_the_words():
    sizes, before = [120, 90, 80, 77, 40, 30, 12, 5, 5, 1], [0.5] * 10
    for seed in range(50):
        found = mixing.land(sizes, mixing.flight(sizes, before, random.Random(seed)), before)
        assert abs(sum(a * b for a, b in zip(found, sizes)) - sum(sizes) / 2) <= 40
        assert abs(sum(found) - 5) <= 1


def test_mix_repeats_rows_as_quotas_say(spark, docs):
    mixed, quotas = mixing.mix(docs), mixing.quotas(docs)
    assert mixed.schema == docs.schema
    assert mixed.count() == sum(r["copies"] for r in quotas.collect())
    sums = {}
    for r in mixed.collect():
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + count(r["text"])
    wanted = {}
    for r in quotas.collect():
        wanted[r["doc_id"]] = wanted.get(r["doc_id"], 0) + r["taken"]
    assert sums == {k: v for k, v in wanted.items() if k in sums} and all(v == 0 for k, v in wanted.items() if k not in sums)


def test_empty_table(spark, no_docs):
    assert mixing.quotas(no_docs).collect() == [] and mixing.mix(no_docs).collect() == []
