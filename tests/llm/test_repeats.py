import hashlib
import random
from collections import Counter

import corpus
import numpy as np
import pytest

from millwatch.llm import repeats


def plain(data, length):
    """Every string of `length` bytes counted."""
    texts = [(doc, (text or "").encode()) for doc, text, *_ in data]
    counts = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    found = []
    for doc, t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int(((gone[1:] != gone[:-1]).sum() + gone[0] + 1) // 2)
        found.append((doc, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=repr)


def pieces(seed, n, alphabet, longest):
    """Texts from shared pieces, cut and edited, so that repeats begin and end anywhere."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randint(10, longest))) for _ in range(12)]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, 4)):
            piece = rng.choice(pool)
            a = rng.randint(0, len(piece) // 2)
            text += piece[a : rng.randint(a, len(piece))]
            if rng.random() < 0.5:
                k = rng.randint(0, len(text))
                text = text[:k] + rng.choice(alphabet) + text[k:]
        rows.append((i, text, None, None, None))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh é"])
def test_short_strings_equal_brute_force(spark, seed, alphabet):
    data = pieces(seed, 60, alphabet, 200) + [(None, "ab" * 90, None, None, None), (7, None, None, None, None)]
    found = repeats.digests(corpus.table(spark, data), length=40, q=16, widths=(12, 4, 1))
    assert corpus.sorted_rows(found) == plain(data, 40)


def test_production_length_equals_brute_force(spark):
    data = corpus.rows() + [(1000 + r[0], *r[1:]) for r in pieces(9, 30, "abcdefghijklmnop ", 1500)]
    found = repeats.digests(corpus.table(spark, data))
    assert corpus.sorted_rows(found) == plain(data, 400)


@pytest.mark.parametrize("partitions", [1, 60])
def test_rows_at_partition_edges(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = pieces(4, 40, "abcd", 150)
        found = corpus.sorted_rows(repeats.digests(corpus.table(spark, data), length=30, q=12, widths=(5, 1)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == plain(data, 30)


def test_every_window_names_a_position_by_its_content():
    rng = random.Random(3)
    text = "".join(rng.choice("abc") for _ in range(900)).encode()
    at, grams, first, last = repeats.sampled(text + b"#" + text, 100, 40)
    assert first[0] == 0 and (first[1:] == last[:-1] + 1).all() and last[-1] == 2 * len(text) + 1 - 100
    offsets = {p: int(a - p) for a, f, l in zip(at, first, last) for p in range(f, l + 1)}
    assert all(0 <= o <= 60 for o in offsets.values())
    assert all(offsets[p] == offsets[p + 901] for p in range(801))
    assert all(x.size == 0 for x in repeats.sampled(b"short", 100, 40))


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    rng = random.Random(5)
    text = bytes(rng.choice(b"xyz") for _ in range(3000))
    whole = repeats.sampled(text, 100, 40)
    monkeypatch.setattr(repeats, "_SLICE", 256)
    parts = repeats.sampled(text, 100, 40)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_kept_text_and_spans(spark):
    passage = "".join(random.Random(1).choice("abcdefgh") for _ in range(500))
    data = [(1, "left " + passage, None, None, None), (2, passage + " right", None, None, None), (3, "alone " * 80, None, None, None)]
    found = {r["doc_id"]: r for r in repeats.dedup(corpus.table(spark, data)).collect()}
    assert bytes(found[1]["kept"]) == b"left " and found[1]["spans"] == [[5, 505]]
    assert bytes(found[2]["kept"]) == b" right" and found[2]["spans"] == [[0, 500]]
    assert bytes(found[3]["kept"]) == b""  # it repeats itself


def passage(rng, words, size):
    """`words` words of `size` bytes in all, spaces included."""
    each, more = divmod(size - words + 1, words)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(each + (k < more))) for k in range(words))


@pytest.mark.parametrize("partitions", [1, 40])
def test_passages_of_over_50_words_go_from_400_bytes_on(spark, partitions):
    rng = random.Random(8)
    data, sizes = [], {}
    for words, size in [(59, 394), (51, 399), (51, 400), (60, 401), (90, 620)] * 4:
        text = passage(rng, words, size)
        for before, after in ("()", "[]"):  # so that the copies share no byte around them
            sizes[len(data)] = size
            data.append((len(data), passage(rng, 40, 300) + before + text + after + passage(rng, 40, 300), None, None, None))
    for _ in range(20):
        sizes[len(data)] = 0
        data.append((len(data), passage(rng, 120, 900), None, None, None))
    found = corpus.sorted_rows(repeats.digests(corpus.table(spark, data).repartition(partitions)))
    assert {doc: n_removed for doc, _, n_removed, *_ in found} == {doc: size * (size >= 400) for doc, size in sizes.items()}
    assert found == plain(data, 400)


def test_empty_table_and_bad_lengths(spark, no_docs):
    assert repeats.digests(no_docs).collect() == []
    with pytest.raises(ValueError):
        repeats.removed_spans(no_docs, 400, 100)
    with pytest.raises(ValueError):
        repeats.removed_spans(no_docs, widths=(34, 6, 1))


def test_long_and_short_documents_in_slices(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_SLICE", 64)
    data = pieces(6, 50, "abcdef", 300)
    found = repeats.digests(corpus.table(spark, data), length=40, q=16, widths=(12, 4, 1))
    assert corpus.sorted_rows(found) == plain(data, 40)
