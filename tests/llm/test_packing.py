import zlib
from collections import defaultdict

import corpus
import numpy as np
import pytest
from tokenizers import Tokenizer

from millwatch.llm import packing, queries

VOCABULARY = queries.vocabulary()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY["vocabulary"])


STRANGE = [
    "", " ", "a  b\t\tc\r\n\r\n d ", "it's they'll I'M", "x<|endoftext|>y", "naïve Größe ¿qué? «très» 12½ ²", "\x85\xa0\x1c\x1d", "漢字 ไทย 🙂", " a​b",
    "tab\tend \n", "Ā ɏ Ȁ", "--- === ...", "12345 6789a", "\x00\x7f", "áë",
]


def test_ids_are_those_of_the_tokenizer(tokenizer):
    fast, exact = packing.encoder(**VOCABULARY), packing.encoder(VOCABULARY["vocabulary"], None)
    for text in [*STRANGE, *(t or "" for _, t, *_ in corpus.rows())]:
        wanted = tokenizer.encode(text, add_special_tokens=False).ids
        assert list(fast(text)) == wanted == list(exact(text))


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000, "word " * 200_000, "x" + "\t " * 500_000 + "y"], ids=["spaces", "lines", "letter", "words", "mixed"])
def test_very_long_texts(spark, tokenizer, text):
    """A long run of white space would end the worker in the faster encoder."""
    wanted = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
    found = packing.pack(corpus.table(spark, [(1, text, None, None, None)]), **VOCABULARY).orderBy("start").collect()
    assert np.frombuffer(b"".join(r["ids"] for r in found), "<u4").tolist() == wanted


def test_runs_at_the_limit_of_the_faster_encoder(tokenizer):
    fast = packing.encoder(**VOCABULARY)
    for n in (9_999, 10_000, 10_001):
        for text in ("a" + " " * n + "b", "a" + "\r\n" * (n // 2) + "b"):
            assert list(fast(text)) == tokenizer.encode(text, add_special_tokens=False).ids


def test_special_strings_can_be_plain_text(tokenizer):
    text = "x<|endoftext|>y"
    plain = packing.encoder(**VOCABULARY, specials=False)
    assert 50256 in packing.encoder(**VOCABULARY)(text) and 50256 not in plain(text)
    assert list(plain(text)) == list(packing.encoder(VOCABULARY["vocabulary"], None, specials=False)(text))


def test_every_id_lies_in_one_piece(spark, tokenizer):
    data = corpus.rows() + [(500 + i, t, None, None, None) for i, t in enumerate(STRANGE)]
    found = packing.pack(corpus.table(spark, data), **VOCABULARY).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["tier"]))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and r["length"] > 0
    wanted = defaultdict(list)
    for doc, text, *_ in data:
        wanted[doc].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    assert pieces.keys() == wanted.keys()
    for doc, texts in wanted.items():
        assert sum(n for _, n, *_ in pieces[doc]) == sum(map(len, texts))
        if len(texts) == 1:
            joined = b"".join(p[2] for p in sorted(pieces[doc]))
            assert np.frombuffer(joined, "<u4").tolist() == texts[0] and all(p[3] == len(texts[0]) for p in pieces[doc])
    padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        if at & (at - 1):
            padded += 2048 - at
    assert padded <= 3 * 2048 + 16 * len(sequences)


def test_rests_go_to_tiers_and_groups_are_even():
    rng = np.random.default_rng(3)
    packer, groups = packing.Packer(), packing.StepGroups()
    dealt = []
    for doc in range(3000):
        for tier, pieces in packer.add(doc, np.zeros(int(rng.integers(1, 3000)), dtype="<u4")):
            dealt += list(groups.add(tier, pieces))
    for tier, pieces in packer.close():
        dealt += list(groups.add(tier, pieces))
    dealt += list(groups.close())
    sizes = [(tier, sum(len(p[2]) for p in pieces)) for _, tier, pieces in dealt]
    assert {tier for tier, _ in sizes} == set(packing.TIERS)
    assert all(n == tier for tier, n in sizes if tier < 2048)
    cost = defaultdict(float)
    for group, tier, pieces in dealt:
        if tier == 2048:
            cost[group] += sum(len(p[2]) ** 2 for p in pieces)
    whole = sorted(cost.values())[1:]
    assert max(whole[:8]) and (np.std(whole) / np.mean(whole)) < 0.25
    cuts = sum(len(pieces) for _, _, pieces in dealt) - 3000
    assert cuts < 3000


def test_empty_table(spark, no_docs):
    assert packing.pack(no_docs, **VOCABULARY).collect() == []
