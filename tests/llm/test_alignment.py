import hashlib
import random
import time
from collections import Counter, defaultdict

import corpus
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given as drawn
from hypothesis import settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millwatch.llm import alignment, queries
from millwatch.llm.common import table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
FILES = {**queries.vocabulary(), "pieces": PIECES}
STRANGE = [
    "x<|endoftext|>y <s> </s> <unk> <0x41>", "  two  spaces ", "tab\tline\n\nend", "漢字 ไทย 🙂", "▁low", "\x00zero", "ﬁ Å é", " ", "a", " ", "🙂" * 40,
    "don't stop 12345 ...", "xyzzy" * 60,
]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(**FILES)


def characters():
    """The byte-level alphabet, from the rule of printable bytes."""
    found, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            found[chr(b)] = b
        else:
            found[chr(256 + n)] = b
            n += 1
    return found


A, B, BYTE = Tokenizer.from_file(FILES["vocabulary"]), sentencepiece.SentencePieceProcessor(model_file=PIECES), characters()
A.encode_special_tokens = True


def tokens(text):
    """(id, start, end) of both tokenizations, or None."""
    if not text:
        return None
    both = []
    for ids, raw in (
        (A.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(BYTE[c] for c in A.id_to_token(i))),
        (B.encode(text), lambda i: bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()),
    ):
        at, found, whole = 0, [], b""
        for i in ids:
            x = raw(i)
            found.append((i, at, at + len(x)))
            at += len(x)
            whole += x
        if whole != (" " + text).encode():
            return None
        both.append(found)
    return both


def overlaps(a, b):
    return [(i, j, min(x[2], y[2]) - max(x[1], y[1])) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]]


def groups(a, b):
    ends = sorted({x[2] for x in a} & {x[2] for x in b})
    return [([x[0] for x in a if s < x[2] <= e], [x[0] for x in b if s < x[2] <= e]) for s, e in zip([0, *ends], ends)]


def brute(texts):
    """The contract over (doc_id, text)."""
    held, docs = [], Counter()
    for doc_id, text in texts:
        both = tokens(text)
        linked = [(both[0][i][0], both[1][j][0]) for i, j, _ in overlaps(*both)] if both else []
        docs.update(set(linked))
        held.append((doc_id, both, linked))
    highest = defaultdict(int)
    for (a, _), n in docs.items():
        highest[a] = max(highest[a], n)
    found = []
    for doc_id, both, linked in held:
        if not both:
            found.append((doc_id, 0, 0, 0, 0, 0, 0, "", 0))
            continue
        parts = groups(*both)
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in parts)
        found.append((
            doc_id, len(both[0]), len(both[1]), len(parts), len(linked), sum(docs[p] == highest[p[0]] for p in linked), sum(docs[p] for p in linked),
            hashlib.sha256(said.encode()).hexdigest(), sum(len(x) * len(y) for x, y in parts),
        ))
    return sorted(found, key=repr)


def texts(seed=3):
    rng = random.Random(seed)
    rows = [(r[0], r[1][:1500] if r[1] else r[1]) for r in corpus.rows(30, seed)]
    return rows + [(900 + i, t) for i, t in enumerate(STRANGE)] + [(950 + i, "".join(rng.choice("ab .é漢\n") for _ in range(60))) for i in range(20)]


@pytest.mark.parametrize("size", [alignment.BATCH, 300], ids=["one batch", "many batches"])
def test_result_matches_brute_force(spark, size):
    rows = texts()
    df = corpus.table(spark, [(*r, None, None, None) for r in rows])
    assert corpus.sorted_rows(alignment.align(df, **FILES, size=size)) == brute(rows)


def test_awkward_tables(spark, docs, no_docs):
    assert sorted(r["doc_id"] or -1 for r in alignment.align(docs, **FILES).collect()) == sorted(r["doc_id"] or -1 for r in docs.collect())
    assert alignment.align(no_docs, **FILES).count() == 0
    empty = corpus.table(spark, [(1, None, None, None, None), (2, "", None, None, None)])
    assert corpus.sorted_rows(alignment.align(empty, **FILES)) == [(1, 0, 0, 0, 0, 0, 0, "", 0), (2, 0, 0, 0, 0, 0, 0, "", 0)]


def test_links_are_all_overlaps(aligner):
    for _, text in texts(4):
        found, both = aligner.align(text or ""), tokens(text)
        assert (found is None) == (both is None)
        if found:
            assert list(zip(*(x.tolist() for x in found.links()))) == overlaps(*both)


def test_group_links_are_the_products_of_groups(aligner):
    for text in ("xyzzy" * 60, "It's a naïve façade, isn't it?", "🙂 漢字" * 9):
        found, both = aligner.align(text), tokens(text)
        ends = sorted({x[2] for x in both[0]} & {x[2] for x in both[1]})
        group = lambda x: next(k for k, e in enumerate(ends) if x[2] <= e)
        wanted = [(i, j) for i, x in enumerate(both[0]) for j, y in enumerate(both[1]) if group(x) == group(y)]
        for block in (1, 7, 1 << 20):
            parts = list(found.group_links(block))
            assert [(i, j) for p in parts for i, j in zip(p[0].tolist(), p[1].tolist())] == wanted
        assert found.n_group_links() == len(wanted)


@settings(max_examples=60, deadline=None)
@drawn(st.data())
def test_row_products_are_matrix_products(data):
    n, m, k = (data.draw(st.integers(1, 7)) for _ in range(3))
    cells = lambda r, c: np.array(data.draw(st.lists(st.integers(0, 2), min_size=r * c, max_size=r * c))).reshape(r, c)

    def sparse(x):
        row, column = np.nonzero(x)
        return alignment.Sparse(np.r_[0, np.cumsum(np.bincount(row, minlength=len(x)))], column, x[row, column], x.shape[1])

    a, b = cells(n, m), cells(k, m)
    out = np.zeros((n, k), dtype=int)
    for row, column, value in sparse(a).times(sparse(b).transposed(), data.draw(st.integers(1, 20))):
        out[row, column] += value
    assert (out == a @ b.T).all()


def test_entries_spell_the_texts(aligner):
    assert aligner.bytes_a[A.token_to_id("Ġthe")] == b" the" and len(aligner.bytes_a) == A.get_vocab_size()
    assert all(len(x) for x in aligner.bytes_a) and len(aligner.bytes_b) == B.get_piece_size()


def test_links_table_spans_both_tokenizations(spark):
    rows = [(1, "It's naïve"), (2, None), (3, "a▁b")]
    found = {r["doc_id"]: r for r in alignment.links(corpus.table(spark, [(*r, None, None, None) for r in rows]), **FILES).collect()}
    both = tokens("It's naïve")
    assert found[1]["a_ids"] == [x[0] for x in both[0]] and [tuple(x) for x in found[1]["links"]] == overlaps(*both)
    assert found[1]["group_ends"][-1] == len(" It's naïve".encode()) and found[2]["links"] == [] == found[3]["a_ids"]


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000, "word " * 200_000, "漢" * 300_000], ids=["spaces", "lines", "letter", "words", "bytes"])
def test_long_texts(aligner, text):
    start = time.perf_counter()
    found = aligner.align(text)
    if found:
        i, j, shared = found.links()
        assert shared.sum() == len((" " + text).encode()) and len(i) == len(found.a) + len(found.b) - len(found.shared_ends)
        assert found.n_group_links() >= len(i)
    assert time.perf_counter() - start < 60


def test_given_documents(spark, given):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, given, "documents").collect()]
    found = {r["doc_id"]: r for r in queries.QUERIES["op13_token_alignment"](spark, given).collect()}
    assert len(found) == len(rows)
    small = [r for r in rows if len(r[1] or "") < 1200][:40]
    for w in brute(small):
        r = found[w[0]]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) == (*w[1:5], w[7])
        assert w[5] <= w[4] and r["count_sum"] >= w[6]
