import hashlib
import zlib
from collections import defaultdict

import corpus
import numpy as np
import pytest

from millwatch.llm import common, lines


def plain(data, least_chars=40, least_docs=5):
    """Rows of (doc, n_lines, n_dropped, digest, kept text) by looking at all lines."""
    holders = defaultdict(set)
    key = lines.line_key
    for doc, text, *_ in data:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    found = []
    for doc, text, *_ in data:
        all_lines = (text or "").split("\n")
        kept = []
        for line in all_lines:
            docs = holders[key(line)]
            largest = max((d for d in docs if d is not None), default=None)
            if len(key(line)) < least_chars or len(docs) < least_docs or doc == largest:
                kept.append(line)
        text = "\n".join(kept)
        found.append((doc, len(all_lines), len(all_lines) - len(kept), hashlib.sha256(text.encode()).hexdigest(), text))
    return sorted(found, key=repr)


def data():
    shared = ["x" * 39, "y" * 40, "Ünder " * 9, "  Mixed CASE line of at least forty characters \x0b"]
    found = corpus.rows()
    for i in range(200, 230):
        rest = [s if i % 2 else s.strip().lower() for k, s in enumerate(shared) if i % (k + 2) == 0]
        found.append((i, "\n".join([*rest, f"own line {i}", *rest]), None, None, None))
    # a null id counts as a document, and as the smallest
    return found + [(None, shared[1], None, None, None)]


def test_key_strips_and_lowers_ascii_only():
    assert lines.line_key("\t ÀBC\xa0 \r") == "Àbc\xa0"
    assert lines.line_key("\x1cA") == "\x1ca"


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_digests_equal_brute_force(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # runs of equal lines span partitions
    try:
        found = corpus.sorted_rows(lines.digests(corpus.table(spark, data())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == [r[:4] for r in plain(data())]


@pytest.mark.parametrize("n", [4, 5, 60])
def test_one_line_in_many_documents(spark, n):
    rows = [(i, "the very same line in each of many documents here", None, None, None) for i in range(n)]
    found = {r["doc_id"]: r["n_dropped"] for r in lines.digests(corpus.table(spark, rows)).collect()}
    assert found == {i: int(n >= 5 and i < n - 1) for i in range(n)}


def test_bitmaps_and_texts(spark):
    table = corpus.table(spark, data())
    for r in lines.keep_bitmaps(table).collect():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r["keep"]), dtype=np.uint8))[: r["n_lines"]]
        assert (bits == 0).sum() == r["n_dropped"] > 0
    kept = lines.dedup(table)
    assert kept.schema == table.schema
    texts = sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=repr)
    assert texts == sorted(((r[0], r[4]) for r in plain(data())), key=repr)
    assert all(r["n_chars"] == len(r["text"]) for r in kept.collect() if r["text"] is not None)


def test_empty_table(spark, no_docs):
    assert lines.digests(no_docs).collect() == [] and lines.dedup(no_docs).collect() == []
    assert common.DOC in lines.keep_bitmaps(no_docs).columns
