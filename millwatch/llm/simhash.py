"""SimHash near-dedup with a Gray-order hierarchical index.

Distinct fingerprints meet in buckets that share two of five bit blocks, which
any pair within three bits does. In a bucket they are sorted by Gray rank, so
neighbours share bits; upper nodes hold the bits that all their members share,
lower nodes only the further ones, and a search drops a whole node as soon as the
differences gathered on the way exceed the limit. A bucket answers with a
spanning forest of its links; components come from star contractions.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.llm import common
from millwatch.session import materialise

SEED = 42
FANOUT = 8
BUCKET = 4096
QUERIES = 256
_CHUNK = 1 << 15


def fingerprint(text: str, words: int = 3) -> int:
    """Majority bits of the XXH64 hashes of all word shingles; 0 without words."""
    tokens = text.encode().lower().split()  # on bytes both mind ASCII only
    n = max(1, len(tokens) - words + 1) if tokens else 0
    if not n:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(words, len(tokens)) - 1 :].tolist()
    hash_of, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for k in range(0, n, _CHUNK):
        some = np.array([hash_of(joined[a:b], SEED) for a, b in zip(starts[k : k + _CHUNK], stops[k : k + _CHUNK])], dtype="<u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """Document key and `fp`, the fingerprint as a signed long."""
    schema = pa.schema([("__doc", pa.int64()), ("__mark", pa.int64()), ("fp", pa.int64())])

    def run(parts):
        for part in parts:
            found = np.array([fingerprint(t, words) for t in part.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, type=pa.int64())], schema=schema)

    return common.texts(docs).mapInArrow(run, "__doc long, __mark long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence."""
    ranks = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        ranks ^= ranks >> np.uint64(shift)
    return ranks


class GrayIndex:
    """Codes in Gray order under a tree of `FANOUT` neighbours a node.

    levels[0] are the codes. A node's mask holds the bits all codes below share
    and its parent's mask lacks, its bits their values.
    """

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        both, either = [self.codes], [self.codes]
        while len(both[-1]) > 1:
            cuts = np.arange(0, len(both[-1]), FANOUT)
            both.append(np.bitwise_and.reduceat(both[-1], cuts))
            either.append(np.bitwise_or.reduceat(either[-1], cuts))
        shared = [~(a ^ o) for a, o in zip(both, either)]
        self.nodes = []  # from the root down: own mask, bits
        above = np.zeros(1, dtype=np.uint64)
        for level in range(len(both) - 1, -1, -1):
            parents = above[np.arange(len(both[level])) // FANOUT] if level < len(both) - 1 else above
            self.nodes.append((shared[level] & ~parents, both[level]))
            above = shared[level]

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, code number) of all pairs within `limit` bits."""
        who = np.arange(len(queries))
        node, gathered = np.zeros(len(queries), dtype=np.int64), np.zeros(len(queries), dtype=np.int64)
        for depth, (mask, bits) in enumerate(self.nodes):
            if depth:
                first = node * FANOUT
                n = np.minimum(FANOUT, len(mask) - first)
                who, gathered = np.repeat(who, n), np.repeat(gathered, n)
                node = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            gathered = gathered + np.bitwise_count((queries[who] ^ bits[node]) & mask[node])
            near = gathered <= limit
            who, node, gathered = who[near], node[near], gathered[near]
        return who, node


def forest(codes: np.ndarray, limit: int, queries: int = QUERIES) -> tuple[np.ndarray, np.ndarray]:
    """(root, member) links that connect the codes as all links within `limit` bits do."""
    index = GrayIndex(codes)
    label = np.arange(len(codes))
    for k in range(0, len(codes), queries):
        who, other = index.search(index.codes[k : k + queries], limit)
        who = who + k
        far = label[who] != label[other]
        who, other = who[far], other[far]
        while len(who):
            low = np.minimum(label[who], label[other])
            np.minimum.at(label, label[who], low)
            np.minimum.at(label, label[other], low)
            while (label[label] != label).any():
                label = label[label]
            far = label[who] != label[other]
            who, other = who[far], other[far]
    members = np.flatnonzero(label != np.arange(len(codes)))
    return index.codes[label[members]], index.codes[members]


def links(distinct: DataFrame, limit: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that connect what lies within `limit` bits.

    limit + 2 blocks of which two are shared: pigeonhole, so nothing is lost. A
    bucket of more than `bucket` codes is cut into chunks; each pair of chunks
    meets in one group of at most about twice that size.
    """
    n_blocks = limit + 2
    cuts = [round(64 * i / n_blocks) for i in range(n_blocks + 1)]
    keys = [
        F.struct(
            F.lit(t).alias("t"),
            F.shiftrightunsigned("fp", cuts[a]).bitwiseAND(F.lit((1 << cuts[a + 1] - cuts[a]) - 1)).alias("x"),
            F.shiftrightunsigned("fp", cuts[b]).bitwiseAND(F.lit((1 << cuts[b + 1] - cuts[b]) - 1)).alias("y"),
        )
        for t, (a, b) in enumerate(combinations(range(n_blocks), 2))
    ]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / F.lit(float(bucket))).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
    meetings = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least("mine", j).alias("low"), F.greatest("mine", j).alias("high"))
    )
    dealt = (
        rows.join(sizes, "key").withColumn("chunks", chunks).withColumn("mine", mine)
        .select("fp", "key", F.explode(meetings).alias("pair"))
        .select("fp", "key.t", "key.x", "key.y", "pair.low", "pair.high")
    )
    group = ["t", "x", "y", "low", "high"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def connect(runs):
        for codes in runs:
            roots, members = forest(codes, limit)
            if len(roots):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64), type=pa.int64()) for x in (roots, members)], schema=schema)

    def run(parts):
        def runs():
            rest_key, rest = None, []
            for part in parts:
                codes = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                key = np.column_stack([part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 6)])
                edges = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
                for a, b in zip([0, *edges], [*edges, len(codes)]):
                    here = tuple(key[a])
                    if here != rest_key:
                        if rest_key is not None and sum(map(len, rest)) > 1:
                            yield np.concatenate(rest)
                        rest_key, rest = here, []
                    rest.append(codes[a:b])
            if rest_key is not None and sum(map(len, rest)) > 1:
                yield np.concatenate(rest)

        yield from connect(runs())

    return dealt.repartition(*group).sortWithinPartitions(*group).select("fp", *group).mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) by alternating large and small stars; rows for linked nodes only."""

    def lowest(pairs):  # each node with the smallest of itself and its neighbours
        return pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))

    def measure(pairs):
        row = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    pairs = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = measure(pairs)
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(lowest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = large.join(lowest(large), "u")
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        pairs = materialise(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        before, state = state, measure(pairs)
        if state == before:
            stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    raise RuntimeError(f"the components did not settle in {most_rounds} rounds; raise most_rounds")


def classes(docs: DataFrame, words: int = 3, limit: int = 3) -> DataFrame:
    """Document key, fp, root and component_id: one row per row of `docs`.

    Fingerprints within `limit` bits link. Null and empty texts and texts
    without words have fingerprint zero and link like any other. Null ids never
    name a component unless it has no other. Components can share a name, by a
    null or repeated id; `root`, their smallest linked code, tells them apart. An
    empty table gives no row.
    """
    found = materialise(fingerprints(docs, words))
    distinct = materialise(found.groupBy("fp").agg(F.min(common.DOC).alias("least")))
    stars = components(links(distinct, limit))
    rooted = distinct.join(stars, distinct["fp"] == stars["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_code = rooted.join(named, "root").select("fp", "root", "component_id")
    return found.join(by_code, "fp")


def near_copies(docs: DataFrame, words: int = 3, limit: int = 3) -> DataFrame:
    """doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return classes(docs, words, limit).select(F.col(common.DOC).alias("doc_id"), digits.alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, words: int = 3, limit: int = 3) -> DataFrame:
    """The rows of `docs` that stay: of each component the document with its smallest id (null only if it has no other), once."""
    keyed = classes(docs, words, limit)
    least = F.min(F.col(common.MARK))
    keep = keyed.filter(F.col(common.DOC).eqNullSafe(F.col("component_id"))).groupBy("root", "component_id").agg(least.alias(common.MARK), F.count("*").alias("n"))
    keep = keep.select(F.col("component_id").alias("d"), F.col(common.MARK).alias("m"), "n")
    rows, names = common.numbered(docs)
    rows = common.keyed(rows, names)
    kept = rows.join(keep, rows[common.DOC].eqNullSafe(keep["d"]) & (rows[common.MARK] == keep["m"]))
    # only rows whose id occurs more than once can be repeated
    once, more = kept.filter("n = 1"), kept.filter("n > 1").dropDuplicates(["d", "m"])
    return once.unionByName(more).select(*names.values()).toDF(*docs.columns)
