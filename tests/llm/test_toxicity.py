import zlib

import corpus
import pytest

from millwatch.llm import toxicity
from millwatch.llm.common import table


def test_folding_reads_lookalikes_and_digits():
    assert toxicity.fold("1d10t") == toxicity.fold("idiot") == toxicity.fold("ІDІОТ")
    assert toxicity.fold("c|own") == toxicity.fold("clown")
    assert toxicity.fold("clown!") == toxicity.fold("clown")
    assert toxicity.fold("Größe 1984") == [*toxicity.fold("grosse"), "1984"]
    assert toxicity.fold("") == []


@pytest.mark.parametrize(("text", "word"), [
    ("cl\u200bown", "clown"), ("id\u00adiot", "idiot"), ("i\ufe0fdi\u2060ot", "idiot"), ("ɡarbaɡe", "garbage"), ("c\u04c0own C\u04cfOWN", "clown"),
    ("\u051bueer", "queer"), ("ᴢero", "zero"), ("ƒool", "fool"), ("@sshole", "asshole"), ("$tupid", "stupid"), ("(!diot)", "idiot"),
    ("@clown", "clown"), ("wow !clown", "clown"), ("|clown|", "clown"),
])
def test_disguised_words_are_hits(text, word):
    lexicon = toxicity.Lexicon({toxicity.EDGE + toxicity.fold(word)[0] + toxicity.EDGE: 3.0})
    assert lexicon.features(text, lexicon.matcher())[2] == len(text.split()) - ("wow" in text)


def test_every_letter_has_lookalikes_of_its_own():
    found = [c for letters in toxicity.LOOKALIKES.values() for c in letters]
    assert len(found) == len(set(found)) and set(toxicity.LOOKALIKES) == set("abcdefghijklmnopqrstuvwxyz")
    assert all(toxicity.fold(f"{c}ab") == toxicity.fold(f"{k}ab") for k, letters in toxicity.LOOKALIKES.items() for c in letters)
    assert toxicity.fold("it costs $5 | 7!") == [*toxicity.fold("it costs"), "5", "7"]


def test_exception_phrases_take_hits_back():
    edge = toxicity.EDGE
    lexicon = toxicity.Lexicon({f"{edge}trash{edge}": 3.0, f"{edge}scu": 2.0}, ("trash can",))
    matcher = lexicon.matcher()
    assert lexicon.features("you trash", matcher)[2] == 1
    assert lexicon.features("the trash can", matcher)[2] == 0
    assert lexicon.features("scumbag and sculpture", matcher)[2] == 2
    long, short = ("trash " + "word " * n for n in (2000, 5))
    assert lexicon.features(long, matcher)[1] < lexicon.features(short, matcher)[1]
    assert toxicity.Lexicon().features("trash", toxicity.Lexicon().matcher()) == (0.0, 0.0, 0)


def test_held_out_labels_are_told_apart(spark):
    """Learned without the held-out fifth, the score separates it."""
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    rows = scored.join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    right = sum(r["predicted"] == r["toxic"] for r in held) / len(held)
    clean = [r["predicted"] for r in held if not r["toxic"]]
    assert right > 0.97 and sum(clean) / len(clean) < 0.02
    assert scored.count() == docs.count()


def test_labels_of_held_out_rows_teach_nothing(spark, docs):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = spark.createDataFrame([(i, 1) for i in held] + [(None, 1), (1, None)], "doc_id long, toxic int")
    assert toxicity.learn(docs, labels).entries == {}


@pytest.mark.parametrize("n", [0, 1])
def test_awkward_rows(spark, docs, no_docs, n):
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)] if n else [], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    found = toxicity.score(docs, lexicon).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.score(no_docs, lexicon).collect() == [] and toxicity.learn(no_docs, labels).entries == {}
    kept = toxicity.clean(docs, lexicon)
    assert kept.schema == docs.schema and kept.count() == sum(r["predicted"] == 0 for r in found)
