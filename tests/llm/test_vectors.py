import math
import random

import numpy as np
import pytest

from millwatch.llm import hamming_index, pivots, queries, vectors
from millwatch.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, v string, dim long, `score` int"


def awkward(seed=3, n=400, dim=12):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, list(rows[50][1])) for i in range(30)]  # equal vectors
    rows += [
        (600, None), (700, [0.0] * dim), (800, [1.0, None] + [0.5] * (dim - 2)), (900, [math.nan] * dim), (1000, [math.inf] + [0.0] * (dim - 1)),
        (1100, []), (None, [1.0] * dim), (1200, [0.25, -0.5, 0.75]), (1201, [0.5, 0.5, 0.5]), rows[0], rows[0],
    ]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)


def usable(rows, nonzero):
    found = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or (nonzero and not any(v)):
            continue
        found[i] = np.array(v, dtype=np.float32).astype(float)
    return found


def exact_products(rows, every, k):
    found = {i: np.floor(256 * v) for i, v in usable(rows, False).items()}
    wanted = []
    for q in found:
        if q % every == 0:
            scored = sorted((-int(v @ found[q]), i) for i, v in found.items() if i != q and len(v) == len(found[q]))[:k]
            wanted += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(wanted)


@pytest.mark.parametrize("block", [(16384, 2048), (64, 3)])
def test_products_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "in_blocks", lambda *a, f=vectors.in_blocks: f(*a, *block))
    found = pivots.top_products(frame(spark, awkward()))
    assert sorted(map(tuple, found.collect())) == exact_products(awkward(), 50, 5)


def test_pivot_bounds_stop_early_and_never_wrongly():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 300, (6, 8))
    v = np.floor(centres[rng.integers(0, 6, 3000)] + rng.normal(0, 3, (3000, 8)))
    ids = np.arange(3000)
    chosen = pivots.choose(v, 16)
    for (q, best, scores), i in zip(pivots.search_block(ids, v, ids[:40], v[:40], 5, chosen), range(40)):
        wanted = sorted((-int(x @ v[i]), j) for j, x in enumerate(v) if j != i)[:5]
        assert [(-int(s), int(j)) for s, j in zip(scores, best)] == wanted and (q == i).all()
    assert len(pivots.choose(np.zeros((5, 3)), 4)) == 1


def test_products_beyond_doubles_stay_exact():
    v = np.floor(256 * np.array([[3e14, 1.0], [3e14, 2.0], [1.0, 1.0], [1e30, 0.0]]))
    ids = np.arange(4)
    (_, best, scores), *_ = pivots.search_block(ids, v, ids[:1], v[:1], 3, v[:1])
    rows = [[int(x) for x in r] for r in v]
    wanted = sorted((-sum(a * b for a, b in zip(r, rows[0])), i) for i, r in enumerate(rows) if i)
    assert best.tolist() == [i for _, i in wanted] and scores[0] == 2**63 - 1


@pytest.mark.parametrize("size", [1e15, 1e16, 1e17, 1e200])
def test_an_outlier_among_the_pivots_cuts_no_row(size):
    rng = np.random.default_rng(8)
    v = np.floor(rng.normal(0, 20, (4000, 8)))
    ids = np.arange(4000)
    far = np.full((1, 8), size)
    assert len(pivots.choose(far, 4)) == 0
    for chosen in (pivots.choose(np.concatenate([v[:50], far]), 4), pivots.choose(far, 4)):
        for i, (_, best, scores) in enumerate(pivots.search_block(ids, v, ids[:20], v[:20], 5, chosen)):
            wanted = sorted((-int(x @ v[i]), j) for j, x in enumerate(v) if j != i)[:5]
            assert [(-int(s), int(j)) for s, j in zip(scores, best)] == wanted


def test_pigeonhole_probing_finds_the_whole_ball():
    rng = np.random.default_rng(7)
    codes = rng.integers(0, 1 << 16, (2000, 4)).astype("<u2")
    codes[:500] = codes[0] ^ (1 << rng.integers(0, 16, (500, 4))).astype("<u2")
    index = hamming_index.MultiIndex(codes)
    for radius in (0, 1, 3, 4, 7, 20, 33, 64):
        wanted = np.flatnonzero(hamming_index.hamming(codes, codes[0]) <= radius)
        assert index.within(codes[0], radius).tolist() == wanted.tolist()


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_on_given_vectors(spark, folder):
    path = f"/root/testdata/{folder}"
    found = queries.QUERIES["op4_hamming_neighbours"](spark, path).collect()
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in table(spark, path, "embeddings").collect()}
    ids, v = np.array(list(rows)), np.array(list(rows.values()))
    hits = 0
    asked = [i for i in rows if i % 100 == 0]
    for q in asked:
        distance = np.sqrt(((v - rows[q]) ** 2).sum(axis=1))
        order = [int(i) for i in ids[np.lexsort((ids, distance))] if i != q][:10]
        mine = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(r["score"] == pytest.approx(np.sqrt(((rows[r["vec_id"]] - rows[q]) ** 2).sum()), abs=1e-12) for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(order))
    assert hits / (10 * len(asked)) >= 0.95


def test_neighbours_of_awkward_rows(spark):
    found = hamming_index.nearest(frame(spark, awkward())).collect()
    kept = usable(awkward(), True)
    assert {r["query_id"] for r in found} == {i for i in kept if i % 100 == 0}
    for q in {r["query_id"] for r in found}:
        mine = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        others = [i for i, v in kept.items() if i != q and len(v) == len(kept[q])]
        assert len(mine) == min(10, len(others))
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, None), (50, [0.0])]])
def test_tables_with_nothing_to_find(spark, rows):
    assert hamming_index.nearest(frame(spark, rows)).collect() == []
    assert pivots.top_products(frame(spark, rows)).collect() == []
