import corpus
import pytest

import corpus_pipeline
from millwatch.llm import common, mixing, toxicity
from test_lines import plain as plain_lines
from test_simhash import plain_components, plain_fingerprint

NAMES = ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]


def test_stages_are_those_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES


@pytest.fixture(scope="module")
def steps(spark, given):
    """The documents after each stage, written and read again."""
    docs = common.table(spark, given, "documents")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(common.stored(stage(spark, found[-1], given), name))
    return found


def rows(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()), key=repr)


def test_columns_stay_until_the_last(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_rejected_documents_go(spark, given, steps):
    labels = common.table(spark, given, "labels")
    scored = toxicity.score(steps[0], toxicity.learn(steps[0], labels))
    bad = {r["doc_id"] for r in scored.filter("predicted = 1").collect()}
    assert rows(steps[1]) == [r for r in rows(steps[0]) if r[0] not in bad]
    clean = {r["doc_id"] for r in labels.filter("toxic = 0").collect()}
    assert len(bad & clean) <= 0.02 * len(clean)


def test_lines_and_near_copies_equal_brute_force(steps):
    before = rows(steps[1])
    kept = {doc: text for doc, _, _, _, text in plain_lines(before)}
    assert rows(steps[2]) == sorted(((d, kept[d], lang, s, len(kept[d])) for d, _, lang, s, _ in before), key=repr)
    prints = {r[0]: plain_fingerprint(r[1]) for r in rows(steps[2])}
    tops, least = plain_components(set(prints.values())), {}
    for doc, code in prints.items():
        least[tops[code]] = min(doc, least.get(tops[code], doc))
    assert rows(steps[3]) == [r for r in rows(steps[2]) if r[0] in set(least.values())]


def test_mix_and_pieces(steps):
    copies = {r["doc_id"]: r["copies"] for r in mixing.quotas(steps[3]).collect()}
    assert rows(steps[4]) == sorted((r for r in rows(steps[3]) for _ in range(copies[r[0]])), key=repr)
    tokens, seen = {}, {}
    for r in steps[5].collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
        tokens[r["doc_id"]] = r["doc_tokens"]
    assert seen == {d: n * copies[d] for d, n in tokens.items()} and set(tokens) == {d for d, n in copies.items() if n}


def test_awkward_documents_pass_through(spark, given):
    empty, odd = corpus.empty(spark), corpus.table(spark, corpus.rows())
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, given)
        odd = common.stored(stage(spark, odd, given), name)
        assert empty.count() == 0 and odd.count() > 0
