"""Approximate nearest neighbours by multi-index hashing over learned binary codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.llm import vectors

SUBSTRING = 16


@dataclass
class Coder:
    """Sign codes of learned rotations: bits are the signs of (v - mean) @ planes, in substrings of 16."""

    mean: np.ndarray
    planes: np.ndarray
    radius: int

    def codes(self, v: np.ndarray) -> np.ndarray:
        bits = (v - self.mean) @ self.planes > 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u2")


def rotation(centred: np.ndarray, rng, steps: int = 30) -> np.ndarray:
    """Iterative quantisation: the rotation that brings the rows close to their own signs."""
    dim = centred.shape[1]
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    for _ in range(steps):
        turned = centred @ turn
        u, _, w = np.linalg.svd(np.where(turned > 0, 1.0, -1.0).T @ centred)
        turn = (u @ w).T
    return turn


def hamming(codes: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ query).sum(axis=1, dtype=np.int64)


def learn(sample: np.ndarray, bits: int, k: int, cover: float, seed: int = 42) -> Coder:
    """Fit rotations and the radius on a sample.

    Rotations of independent starts are put side by side until there are `bits`
    bits. The radius takes the share `cover` of the sample's own nearest
    neighbours; those of a larger table are nearer, so it covers them the more.
    """
    rng = np.random.default_rng(seed)
    dim, mean = sample.shape[1], sample.mean(axis=0)
    centred = sample - mean
    norms = np.linalg.norm(centred, axis=1, keepdims=True)
    unit = centred / np.where(norms > 0, norms, 1)
    planes = np.concatenate([rotation(unit, rng) for _ in range(-(-bits // dim))], axis=1)[:, :bits]
    coder = Coder(mean, planes, bits)
    if len(sample) > k:
        codes, gaps = coder.codes(sample), []
        for i in rng.permutation(len(sample))[:256]:
            distance = ((sample - sample[i]) ** 2).sum(axis=1)
            distance[i] = np.inf
            gaps.append(hamming(codes[np.argpartition(distance, k)[:k]], codes[i]))
        coder.radius = int(np.quantile(np.concatenate(gaps), cover, method="higher"))
    return coder


class MultiIndex:
    """For each substring a directory of its values and the rows under them."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        for j in range(codes.shape[1]):
            values, sizes = np.unique(codes[:, j], return_counts=True)
            self.tables.append((values, sizes, np.argsort(codes[:, j], kind="stable")))

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """All rows within `radius` bits.

        With radius = m * a + b over m substrings, one of the first b + 1 is within
        a bits or one of the others within a - 1, so those buckets hold every row.
        """
        m = len(self.tables)
        a, b = divmod(radius, m)
        found = np.zeros(len(self.codes), dtype=bool)
        for j, (values, sizes, order) in enumerate(self.tables):
            near = np.bitwise_count(values ^ query[j]) <= (a if j <= b else a - 1)
            found[order[np.repeat(near, sizes)]] = True
        rows = np.flatnonzero(found)
        return rows[hamming(self.codes[rows], query) <= radius]


def nearest(embeddings: DataFrame, every: int = 100, k: int = 10, bits: int = 256, sample_rows: int = 4096, cover: float = 0.99) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id `every` divides, its nearest rows by Euclidean distance.

    `sample_rows` bounds the rows that rotations and radius are fitted on; every
    row is indexed. Each block gives all rows within the radius, and widens it
    until it has k (or all its rows); distances are then exact, in double
    precision, so only which rows are found is approximate. Only vectors of equal
    length are compared. See `vectors.vectors` for rows that take no part.
    """
    rows = vectors.vectors(embeddings, nonzero=True)
    coders = {dim: learn(v, -(-max(bits, dim) // SUBSTRING) * SUBSTRING, k, cover) for dim, v in vectors.sample(rows, sample_rows).items()}

    def search(ids, v, query_ids, queries):
        coder = coders.get(v.shape[1]) or learn(v[:sample_rows], -(-max(bits, v.shape[1]) // SUBSTRING) * SUBSTRING, k, cover)
        index, asked = MultiIndex(coder.codes(v)), coder.codes(queries)
        out = []
        for query_id, query, code in zip(query_ids, queries, asked):
            radius, most = coder.radius, len(code) * SUBSTRING
            while True:
                near = index.within(code, radius)
                near = near[ids[near] != query_id]
                if len(near) >= k or radius >= most:
                    break
                radius = min(most, radius + SUBSTRING)
            distance = np.sqrt(((v[near] - query) ** 2).sum(axis=1))
            best = np.lexsort((ids[near], distance))[:k]
            out.append((np.full(len(best), query_id), ids[near][best], distance[best]))
        return [np.concatenate(x) for x in zip(*out)]

    found = vectors.in_blocks(rows, F.col("vec_id") % every == 0, search, "double")
    return vectors.ranked(found, k, F.col("score").asc())
