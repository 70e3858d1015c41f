import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus
from millwatch.llm import merkle


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text))


def levels(digests):
    found = [digests]
    while len(found[-1]) > 1:
        found.append([h(found[-1][i : i + 3]) for i in range(0, len(found[-1]), 3)])
    return found


def brute(rows):
    """The contract, row by row."""
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources]
    top = levels([t[-1][0] for t in trees])
    root = top[-1][0]
    found = []
    for k, s in enumerate(sources):
        for i, (_, _, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            text = r[1].replace("\n", "") if tampered and r[1] is not None else r[1]
            fold, proof = leaf(r[0], text, *r[2:]), []
            for tree, at in ((trees[k], i), (top, k)):
                for level in tree[:-1]:
                    run = level[at // 3 * 3 : at // 3 * 3 + 3]
                    proof += run[: at % 3] + run[at % 3 + 1 :]
                    fold = h(run[: at % 3] + [fold] + run[at % 3 + 1 :])
                    at //= 3
            found.append((r[0], own, trees[k][-1][0], root, h(proof), fold, fold == root))
    return sorted(found, key=repr)


def audited(df):
    return corpus.sorted_rows(merkle.newline_audit(df).drop("tampered"))


def table(sizes, seed=1):
    rng, rows, doc = random.Random(seed), [], 0
    for source, n in sizes:
        for _ in range(n):
            rows.append((doc, rng.choice(["a\nb", "plain", "", None, "ü\n\n😀"]), rng.choice([None, "en"]), source, rng.choice([None, 3])))
            doc += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "sizes",
    [
        [("a", 1)], [("a", 2)], [("a", 1), ("b", 1)], [("a", 3), (None, 4), ("", 1), ("ü", 10), ("Z", 28)],
        [(f"s{i}", i % 5 + 1) for i in range(40)], [("hot", 800), ("x", 9), ("y", 27)],
    ],
    ids=["lone", "pair", "lone leaves", "sizes", "many sources", "two passes"],
)
def test_audit_matches_brute_force(spark, sizes):
    rows = table(sizes)
    assert audited(corpus.table(spark, rows)) == brute(rows)


def test_awkward_rows(spark, docs, no_docs):
    assert audited(docs) == brute(corpus.rows())
    assert merkle.newline_audit(no_docs).count() == 0


def test_a_fold_fails_exactly_where_the_text_changed(spark, docs):
    changed = {(r["doc_id"], r["tampered"], r["verified"]) for r in merkle.newline_audit(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for doc_id, tampered, verified in changed:
        assert verified == (not (tampered and "\n" in (texts[doc_id] or "")))


def test_other_tampering_is_found(spark):
    rows = table([("a", 50), ("b", 7)])
    found = merkle.audit(corpus.table(spark, rows), F.col("doc_id").isin(3, 55), F.lit("other")).collect()
    assert {r["doc_id"] for r in found if not r["verified"]} == {3, 55}


def test_ranks_cross_partitions(spark):
    rows = spark.range(0, 5000, 1, 16).select((F.col("id") % 7).alias("a"), F.xxhash64("id").alias("b"))
    found = [r["place"] for r in merkle.ranked(rows, ["a", "b"], "ranks", "place").orderBy("a", "b").collect()]
    assert found == list(range(5000))


def test_nodes_lie_in_buckets_of_their_number(spark, docs):
    tree = merkle.manifest(docs)
    plan = tree.nodes.groupBy("node", "block").count()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan


def test_no_key_of_the_climb_holds_many_leaves(spark):
    """Every leaf meets the row of its own block, and the root's rows are as many as there are blocks."""
    rows = [(i, "t", None, "hot" if i % 3 else f"s{i}", None) for i in range(2400)]
    tree = merkle.manifest(corpus.table(spark, rows, clashes=False))
    blocks = {r["block"] for r in tree.nodes.filter("parent IS NULL").collect()}
    assert blocks == set(range(2400 // merkle.BLOCK + 1))
    assert tree.nodes.groupBy("node", "block").count().filter("count > 1").count() == 0


def test_climb_runs_no_python(spark, docs):
    plan = merkle.newline_audit(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
