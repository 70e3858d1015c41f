import random
import re

import pytest

import corpus
from millwatch.llm import licenses, queries
from millwatch.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, above[j] + 1, above[j - 1] + (x != y)))
    return row[-1]


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    found, given = [], words(text)
    for phrase, label in PHRASES.items():
        asked = phrase.split()
        found += [(i, label) for i in range(len(given)) if given[i : i + len(asked)] == asked]
    return len(given), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def stands(notice, run: str) -> int | None:
    """Fewest edits with which a run of words is the notice, bracketed words untouched."""
    parts = [p for p in re.split(r"(\[[^]]*\])", notice.text) if p]

    def best(at: int, k: int) -> float:
        if k == len(parts):
            return 0 if at == len(run) else float("inf")
        if parts[k][0] == "[":
            core = parts[k][1:-1]
            return best(at + len(core), k + 1) if run.startswith(core, at) else float("inf")
        ends = [len(run)] if k + 1 == len(parts) else range(at, len(run) + 1)
        return min((distance(run[at:e], parts[k]) + best(e, k + 1) for e in ends), default=float("inf"))

    found = best(0, 0)
    return found if found <= notice.edits else None


def brute(text, notices):
    """Labels of notices that some run of whole words is."""
    given, found = words(text), set()
    for notice in notices:
        n = len(notice.plain)
        for i in range(len(given)):
            for j in range(i + 1, len(given) + 1):
                run = " ".join(given[i:j])
                if len(run) > n + notice.edits:
                    break
                if len(run) >= n - notice.edits and stands(notice, run) is not None:
                    found.add(notice.label)
    return ",".join(sorted(found))


def spoiled(rng, text, n):
    for _ in range(n):
        k = rng.randrange(len(text))
        text = rng.choice([text[:k] + text[k + 1 :], text[:k] + rng.choice("aeimnst x") + text[k:], text[:k] + rng.choice("aeimnst") + text[k + 1 :]])
    return text


def noisy(seed=5, n=120):
    rng = random.Random(seed)
    for _ in range(n):
        parts = [corpus.words(rng, rng.randint(0, 6))]
        for _ in range(rng.randint(1, 3)):
            notice = rng.choice(licenses.NOTICES)
            parts += [spoiled(rng, notice.plain, rng.randint(0, notice.edits + 2)), corpus.words(rng, rng.randint(0, 3))]
        yield " ".join(parts)


ODD = [
    None, "", " .,!", "Under the MIT License", "UNDER-THE/MIT\nLicense under the mit license", "under the mit licenses", "Under the MlT License",
    "under the mpl license", "Apache Licence, Version 2.0", "Apache License, Version 1.0", "apache license version 20", "CC-BY-NC 4.0, cc by nc cc by nc",
    "cc by-nd", "under the mit", "under the mit license" * 3, "licencse " * 50, "GNU Lesser General Public License, version 3", "Ünder the mit license",
    "gnu general public license version 2 gnu general public license version 3", "Creative Commons Attribution-NonCommercial 4.0",
]


def rows(spark, texts, clashes=True):
    data = [(i, t, None, None, None) for i, t in enumerate(texts)]
    return {r["doc_id"]: r for r in licenses.labelled(corpus.table(spark, data, clashes)).collect()}


def test_base_places_and_labels_match_brute_force(spark):
    texts = [*ODD, *noisy()]
    found = rows(spark, texts)
    for i, text in enumerate(texts):
        r = found[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(text), text
        assert r["labels"] == brute(text, licenses.NOTICES), text


def test_reported_spans_are_the_notice(spark):
    for text in [*ODD, *noisy(6, 60)]:
        given = words(text)
        for i, start, end, edits in licenses.Finder().find(licenses.folded(text or "")):
            notice, run = licenses.NOTICES[i], " ".join(given)[start:end]
            least = stands(notice, run)
            assert least is not None and least <= edits <= notice.edits, (text, run)


def test_cases(spark):
    found = rows(spark, ODD)
    labels = {ODD[i]: r["labels"] for i, r in found.items()}
    assert labels["Under the MlT License"] == "" and labels["under the mpl license"] == ""  # the name itself bears no edit
    assert labels["Apache Licence, Version 2.0"] == "apache-2" and labels["Apache License, Version 1.0"] == "" == labels["apache license version 20"]
    assert labels["GNU Lesser General Public License, version 3"] == ""
    near = found[ODD.index("Apache Licence, Version 2.0")]
    assert (near["n_base"], near["first_word"], near["base_labels"]) == (0, None, "") and 0 < near["score"] < 1
    assert near["found"][0]["words"] == "apache licence version 2" and near["found"][0]["edits"] == 1
    assert found[3]["score"] == 1.0 and found[0]["score"] == 0.0 and found[0]["n_words"] == 0


def test_every_row_has_one_result(spark, docs, no_docs):
    assert sorted(r["doc_id"] or -1 for r in licenses.labelled(docs).collect()) == sorted(r["doc_id"] or -1 for r in docs.collect())
    assert licenses.labelled(no_docs).count() == 0


@pytest.mark.parametrize("text", ["license " * 150_000, "under the mit " * 80_000, "x" * 1_000_000, " " * 1_000_000], ids=["seed", "begun", "word", "space"])
def test_long_texts_take_linear_time(text):
    import time

    start = time.perf_counter()
    licenses.Finder().find(licenses.folded(text))
    assert time.perf_counter() - start < 60


def test_seeds_survive_any_edits():
    rng = random.Random(9)
    for notice in licenses.NOTICES:
        for _ in range(50):
            text = spoiled(rng, notice.plain, notice.edits)
            assert any(seed in text for _, seed in notice.seeds)


def test_phrases_must_be_notices(docs):
    with pytest.raises(ValueError):
        licenses.labelled(docs, licenses.NOTICES[1:])


def test_given_documents_against_brute_base(spark, given):
    texts = {r["doc_id"]: r["text"] for r in table(spark, given, "documents").collect()}
    found = queries.QUERIES["op11_license_notices"](spark, given).collect()
    assert len(found) == len(texts)
    for r in found:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert (r["score"] == 1.0) >= bool(r["n_base"])
