import random

import corpus
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millwatch.llm import simhash


def plain_fingerprint(text, words=3):
    tokens = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        tokens = tokens.replace(c, " ")
    tokens = [t for t in tokens.split(" ") if t]
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(codes, limit=3):
    """Smallest member of each code's component, by comparing all."""
    group = {c: c for c in codes}

    def top(c):
        while group[c] != c:
            c = group[c]
        return c

    codes = sorted(codes)
    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= limit:
                group[max(top(a), top(b))] = min(top(a), top(b))
    return {c: top(c) for c in codes}


def near_codes(seed, n, bits=64):
    rng = random.Random(seed)
    codes = {0, (1 << 64) - 1}
    while len(codes) < n:
        code = rng.getrandbits(64) if rng.random() < 0.3 else rng.choice(sorted(codes)[:40])
        for _ in range(rng.randint(0, 4)):
            code ^= 1 << rng.randrange(bits)
        codes.add(code)
    return sorted(codes)


@pytest.mark.parametrize("text", ["", "One", "one two", "A  B\tc\nD e\x0bF", "ä Ö\xa0x y", "w " * 70000, None])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "") == plain_fingerprint(text)


def test_spark_hashes_shingles_alike(spark):
    (h,) = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()
    assert h % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65, 700])
def test_index_finds_all_pairs(n):
    codes = np.array(near_codes(n, max(n, 3))[:n], dtype=np.uint64)
    index = simhash.GrayIndex(codes)
    assert sorted(index.codes.tolist()) == sorted(codes.tolist())
    who, node = index.search(codes, 3)
    found = {(int(codes[i]), int(index.codes[j])) for i, j in zip(who, node)}
    assert found == {(int(a), int(b)) for a in codes for b in codes if (int(a) ^ int(b)).bit_count() <= 3}


def test_gray_neighbours_differ_in_one_bit():
    codes = np.arange(64, dtype=np.uint64)
    in_order = codes[np.argsort(simhash.gray_rank(codes))]
    assert all(int(a ^ b).bit_count() == 1 for a, b in zip(in_order, in_order[1:]))


@pytest.mark.parametrize("bucket", [4, 4096])
def test_links_and_components_equal_brute_force(spark, bucket):
    codes = near_codes(11, 400, 20)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    table = spark.createDataFrame([(c,) for c in signed], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(table, 3, bucket)).collect()}
    groups, brute = {}, {}
    for c, s in zip(codes, signed):
        groups.setdefault(found.get(s, s), set()).add(c)
    for c, top in plain_components(codes).items():
        brute.setdefault(top, set()).add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))
    assert all(root == min(s for s in signed if found.get(s, s) == root) for root in set(found.values()))


def test_documents(spark, docs):
    data = corpus.rows()
    found = simhash.near_copies(docs).collect()
    prints = {text: plain_fingerprint(text) for _, text, *_ in data}
    tops = plain_components(set(prints.values()))
    least = {}
    for doc, text, *_ in data:
        top = tops[prints[text]]
        if doc is not None:
            least[top] = min(least.get(top, doc), doc)
    wanted = [(doc, f"{prints[text]:016x}", least.get(tops[prints[text]])) for doc, text, *_ in data]
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)
    kept = simhash.dedup(docs)
    assert kept.schema == docs.schema
    named = [tops[prints[r["text"]]] for r in kept.collect()]
    assert len(named) == len(set(named)) == len(set(tops[prints[t]] for _, t, *_ in data))
    assert all(r["doc_id"] == least.get(tops[prints[r["text"]]]) for r in kept.collect())


def test_components_that_share_an_id_keep_one_document_each(spark):
    rng = random.Random(5)
    a, b, c, d, e = (corpus.words(rng, 60) for _ in range(5))
    data = [(i, t, None, None, None) for i, t in [(None, a), (None, a), (None, b), (7, c), (7, d), (7, d), (8, d), (None, c), (9, e), (None, e)]]
    kept = simhash.dedup(corpus.table(spark, data)).collect()
    assert sorted((repr(r["doc_id"]), r["text"]) for r in kept) == sorted([("None", a), ("None", b), ("7", c), ("7", d), ("9", e)])


def test_empty_table(spark, no_docs):
    assert simhash.near_copies(no_docs).collect() == [] and simhash.dedup(no_docs).collect() == []
