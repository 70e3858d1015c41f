"""Exact top-k by inner product with a pivot table.

Distances of all rows to many pivots are computed beforehand. For a query the
largest difference of pivot distances bounds its distance to a row from below
and so, lengths being known, their inner product from above. Rows are evaluated
in the order of that bound until no bound reaches the k-th best score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.llm import vectors

STEP = 512
EXACT = 2.0**53
LONG = 2**63


def quantise(v: np.ndarray) -> np.ndarray:
    """floor(256 * x) of every component, as doubles that are whole numbers."""
    return np.floor(256.0 * v)


def choose(sample: np.ndarray, n: int) -> np.ndarray:
    """Pivots far from each other: each next one is the row farthest from those chosen.

    Rows so long that distances to them would be rounded are no pivots; none may be left.
    """
    with np.errstate(over="ignore"):
        sample = sample[(sample**2).sum(axis=1) < EXACT]
    if not len(sample):
        return sample
    chosen = [int(np.argmax((sample**2).sum(axis=1)))]
    near = np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        if near.max() <= 0:
            break
        chosen.append(int(np.argmax(near)))
    return sample[chosen]


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (v**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * v @ pivots.T))


def _plain(ids, v, query_ids, queries, k):
    """Scores with whole numbers of any size, for components whose products doubles can't hold."""
    rows = [[int(x) for x in row] for row in v]
    for query_id, query in zip(query_ids, queries):
        asked = [int(x) for x in query]
        scores = [(-sum(a * b for a, b in zip(row, asked)), int(i)) for row, i in zip(rows, ids) if i != query_id]
        best = sorted(scores)[:k]
        held = [max(-LONG, min(LONG - 1, -s)) for s, _ in best]
        yield np.full(len(best), query_id), np.array([i for _, i in best], dtype=np.int64), np.array(held, dtype=np.int64)


def search_block(ids, v, query_ids, queries, k, pivots):
    """Exact best k of each query among the rows, by falling bound."""
    top = float(np.abs(v).max(initial=0)) * float(np.abs(queries).max(initial=0)) * v.shape[1]
    if max(top, float((v**2).sum(axis=1).max(initial=0)), float((queries**2).sum(axis=1).max(initial=0))) >= EXACT:
        yield from _plain(ids, v, query_ids, queries, k)
        return
    table, asked = distances(v, pivots), distances(queries, pivots)
    squares, own = (v**2).sum(axis=1), (queries**2).sum(axis=1)
    for query_id, query, d, square in zip(query_ids, queries, asked, own):
        low = np.abs(table - d).max(axis=1, initial=0)
        # the slack covers rounding in the pivot distances
        bound = (squares + square - low**2) / 2 + 1e-7 * (squares + square) + 1e-3
        order = np.argsort(-bound, kind="stable")
        order = order[ids[order] != query_id]
        best_ids, best = np.empty(0, dtype=np.int64), np.empty(0)
        for at in range(0, len(order), STEP):
            some = order[at : at + STEP]
            if len(best) == k and bound[some[0]] < best[-1]:
                break
            best_ids = np.concatenate([best_ids, ids[some]])
            best = np.concatenate([best, v[some] @ query])
            first = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[first], best[first]
        yield np.full(len(best), query_id), best_ids, best.astype(np.int64)


def top_products(embeddings: DataFrame, every: int = 50, k: int = 5, n_pivots: int = 32, sample_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id `every` divides, the k rows of highest integer inner product.

    Components become floor(256 * x). Pivots come from at most `sample_rows` rows;
    they change the work, never the result. Scores beyond a long stop at its
    limits. Only vectors of equal length are compared. See `vectors.vectors` for
    rows that take no part.
    """
    rows = vectors.vectors(embeddings, nonzero=False)
    pivots = {dim: choose(quantise(v), n_pivots) for dim, v in vectors.sample(rows, sample_rows).items()}

    def search(ids, v, query_ids, queries):
        v, queries = quantise(v), quantise(queries)
        own = pivots.get(v.shape[1])
        found = list(search_block(ids, v, query_ids, queries, k, choose(v[:sample_rows], n_pivots) if own is None else own))
        return [np.concatenate(x) for x in zip(*found)]

    found = vectors.in_blocks(rows, F.col("vec_id") % every == 0, search, "long")
    return vectors.ranked(found, k, F.col("score").desc())
