"""Toxicity: a weighted lexicon, matched by Aho-Corasick over folded text.

Texts and lexicon are folded alike: compatibility forms, accents, look-alike
letters of other scripts and digits that stand for letters. Entries are whole
words or word beginnings, weighed by their log-odds in labelled documents;
exception phrases take a hit back. The sum of weights, as it is and divided by
length, goes through a logistic curve.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.llm import common

#: Letters of other scripts and marked or small capital letters by the Latin letter they look like.
LOOKALIKES = {
    "a": "аɑαᴀ", "b": "ьвβʙ", "c": "сςᴄ", "d": "ԁđᴅ", "e": "еєεᴇ", "f": "ƒϝꜰ", "g": "ɡցɢ", "h": "һнħʜ", "i": "іιıɪ", "j": "јᴊ", "k": "кκᴋ",
    "l": "ӏłǀʟ", "m": "мᴍ", "n": "пηոɴ", "o": "оοσᴏ", "p": "рρᴘ", "q": "ԛզ", "r": "гʀ", "s": "ѕꜱ", "t": "тτŧᴛ", "u": "υսᴜ", "v": "νᴠ",
    "w": "ѡωԝᴡ", "x": "хχ", "y": "уγʏ", "z": "ᴢʐ",
}
#: What is not seen in a word, format characters and joiners.
UNSEEN = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Cf" or c == "\u034f" or "\ufe00" <= c <= "\ufe0f"]
#: Digits and signs by the letter they stand for; i, l and 1 become one letter.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
FOLD = str.maketrans({c: k for k, v in LOOKALIKES.items() for c in v} | {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o"} | dict.fromkeys(UNSEEN))
#: Before and between letters the signs are read as letters; a sign at a word's end is punctuation.
TOKEN = re.compile(r"(?:[^\W_]|[@$!|](?=[^\W\d_]))(?:[^\W_]|[@$!|](?=[^\W_]))*")
SIGNED = re.compile(r"[@$!|][^\W\d_]")
SUBSTITUTE = str.maketrans(DIGITS)
EDGE = "\x00"
PREFIXES = range(4, 9)


def fold(text: str) -> list[str]:
    """Folded words of a text, in order; numbers stay numbers. A word after a sign is given with and without it."""
    text = text.lower()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower().translate(FOLD)
    words = TOKEN.findall(text)
    if SIGNED.search(text):
        words = [form for w in words for form in ((w,) if w[0].isalnum() else (w, w[1:]))]
    return [w if w.isdigit() else w.translate(SUBSTITUTE) for w in words]


@dataclass
class Lexicon:
    """Entries (`EDGE`-framed) with weights, exception phrases, and the curve."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-4.0, 1.0, 0.0)

    def matcher(self):
        found = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            found.add_word(entry, (weight, len(entry)))
        for phrase in self.exceptions:
            found.add_word(f"{EDGE}{EDGE.join(fold(phrase))}{EDGE}", (None, len(EDGE.join(fold(phrase))) + 2))
        if len(found):
            found.make_automaton()
        return found

    def features(self, text: str, matcher) -> tuple[float, float, int]:
        """Sum of weights, the same per root of 100 words, and the number of hits. Hits inside exception phrases don't count."""
        words = fold(text)
        if not words or not len(matcher):
            return 0.0, 0.0, 0
        hits: dict[int, float] = {}  # the heaviest entry that starts at a place
        excused: list[tuple[int, int]] = []
        for last, (weight, length) in matcher.iter(f"{EDGE}{EDGE.join(words)}{EDGE}"):
            start = last - length + 1
            if weight is None:
                excused.append((start, last))
            elif weight > hits.get(start, 0.0):
                hits[start] = weight
        if excused:
            hits = {s: w for s, w in hits.items() if not any(a <= s < b for a, b in excused)}
        total = sum(hits.values())
        return total, total / math.sqrt(max(1.0, len(words) / 100)), len(hits)

    def score(self, features) -> float:
        z = self.curve[0] + self.curve[1] * math.log1p(features[1]) + self.curve[2] * math.log1p(features[0])
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def _entries(words) -> set[str]:
    found = set()
    for w in set(words):
        if len(w) >= 3 and not w.isdigit():
            found.add(f"{EDGE}{w}{EDGE}")
            found.update(EDGE + w[:k] for k in PREFIXES if k < len(w))
    return found


def learn(documents: DataFrame, labels: DataFrame, sample_rows: int = 12_000, most_entries: int = 2000, least_count: int = 5, least_weight: float = 2.0, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learn entries, exceptions and curve from labelled rows that are not held out.

    At most `sample_rows` labelled rows, those of the smallest id hashes, are
    used; `most_entries` bounds the lexicon. Rows without a label, id or
    document teach nothing; an id labelled both ways counts as toxic. With no
    toxic row the lexicon stays empty and every score is low.
    """
    marked = (
        labels.select(F.col("doc_id").cast("long").alias(common.DOC), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col(common.DOC).isNotNull() & F.col("toxic").isNotNull()).filter(~held_out(common.DOC))
        .groupBy(common.DOC).agg(F.max("toxic").alias("toxic"))
    )
    marked = common.hashed_sample(marked, common.DOC, sample_rows)
    text = common.texts(documents).select(common.DOC, "text")
    # kept as a table: cached, its texts would take the heap that scoring needs
    sample = text.join(F.broadcast(marked), common.DOC).repartition(common.DOC).select("text", "toxic")
    sample = common.stored(sample, "toxicity-sample")
    counts = pa.schema([("entry", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())])

    def count(parts):
        held: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def out():
            for entry in held[0].keys() | held[1].keys():
                yield entry, held[1][entry], held[0][entry]

        for part in common.slices(parts):
            for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                held[1 if y else 0].update(_entries(fold(t)))
                if len(held[0]) + len(held[1]) > 100_000:
                    yield from common.batches(out(), counts)
                    held = {0: Counter(), 1: Counter()}
        yield from common.batches(out(), counts)

    n = {bool(r["toxic"]): r["n"] for r in sample.groupBy((F.col("toxic") != 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = n.get(True, 0), n.get(False, 0)
    if not n_pos:
        return Lexicon(exceptions=exceptions)
    weight = F.log((F.col("pos") + 0.5) / (n_pos + 1.0)) - F.log((F.col("neg") + 0.5) / (n_neg + 1.0))
    rows = (
        sample.mapInArrow(count, "entry string, pos long, neg long")
        .groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .filter(F.col("pos") >= least_count).withColumn("weight", weight).filter(F.col("weight") >= least_weight)
        .orderBy(F.desc(F.col("weight") * F.sqrt("pos")), "entry").limit(most_entries).collect()
    )
    chosen: dict[str, tuple[float, int]] = {}
    for r in rows:  # the best first; an entry that a better, longer or shorter one covers is left out
        entry = r["entry"]
        chain = [entry[:k] for k in range(2, len(entry))]
        if any(c in chosen and chosen[c][0] >= r["weight"] - 1.0 for c in chain):
            continue
        if any(c.startswith(entry.rstrip(EDGE)) and chosen[c][1] >= 0.8 * r["pos"] for c in chosen):
            continue
        chosen[entry] = (r["weight"], r["pos"])
    lexicon = Lexicon({e: w for e, (w, _) in chosen.items()}, exceptions)
    lexicon.exceptions += _exceptions(sample, lexicon, n_pos, n_neg)
    lexicon.curve = _curve(sample, lexicon)
    return lexicon


def _exceptions(sample: DataFrame, lexicon: Lexicon, n_pos: int, n_neg: int, most: int = 500, least: int = 5) -> tuple[str, ...]:
    """Two-word phrases around a hit that clean documents hold far more often than toxic ones."""
    entries = tuple(lexicon.entries)

    def phrases(parts):
        schema = pa.schema([("phrase", pa.string()), ("toxic", pa.int32())])
        exact = {e.strip(EDGE) for e in entries if e.endswith(EDGE)}
        starts = {e.strip(EDGE) for e in entries if not e.endswith(EDGE)}

        def out(part):
            for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words, found = fold(t), set()
                for i, w in enumerate(words):
                    if w in exact or any(w[:k] in starts for k in PREFIXES):
                        found.update(" ".join(words[j : j + 2]) for j in (i - 1, i) if 0 <= j < len(words) - 1)
                yield from ((p, int(bool(y))) for p in found)

        for part in common.slices(parts):
            yield from common.batches(out(part), schema)

    clean = F.count(F.when(F.col("toxic") == 0, 1))
    rows = (
        sample.mapInArrow(phrases, "phrase string, toxic int").groupBy("phrase")
        .agg(clean.alias("neg"), F.sum("toxic").alias("pos"))
        .filter((F.col("neg") >= least) & (F.col("neg") / float(n_neg + 1) > 4 * (F.col("pos") + 0.5) / float(n_pos + 1)))
        .orderBy(F.desc("neg"), "phrase").limit(most).collect()
    )
    return tuple(r["phrase"] for r in rows)


def _curve(sample: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """Logistic regression by Newton steps over the sample's two sums, lightly ridged."""
    schema = pa.schema([("a", pa.float64()), ("b", pa.float64()), ("y", pa.float64())])

    def run(parts):
        matcher = lexicon.matcher()
        for part in common.slices(parts):
            def out(part=part):
                for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    total, dense, _ = lexicon.features(t, matcher)
                    yield math.log1p(dense), math.log1p(total), float(bool(y))
            yield from common.batches(out(), schema)

    # at most sample_rows; sorted, so that sums don't depend on the order of tasks
    rows = np.array(sorted(sample.mapInArrow(run, "a double, b double, y double").collect()), dtype=float)
    x, y = np.column_stack([np.ones(len(rows)), rows[:, :2]]), rows[:, 2]
    w = np.zeros(3)
    ridge = np.diag([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits: one row per row of `documents`.

    Null and empty texts have no hit and get the score of a text without hits;
    a null id is never held out; repeated rows are scored alike. An empty table
    gives no row.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_hits", pa.int64())])

    def run(parts):
        matcher = lexicon.matcher()

        def rows(part):
            for doc, text in zip(*(column.to_pylist() for column in part.columns)):
                found = lexicon.features(text, matcher)
                yield doc, lexicon.score(found), found[2]

        for part in common.slices(parts):
            yield from common.batches(rows(part), schema)

    scored = common.texts(documents).select(common.DOC, "text").mapInArrow(run, "doc_id long, score double, n_hits long")
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", predicted.alias("predicted"), "n_hits")


def clean(documents: DataFrame, lexicon: Lexicon, least: float = 0.5) -> DataFrame:
    """The rows of `documents` that score under `least`, all columns as they are."""

    def run(parts):
        matcher = lexicon.matcher()
        for part in common.slices(parts):
            texts = part.column(part.schema.names.index("text")).to_pylist()
            yield part.filter(pa.array([lexicon.score(lexicon.features(t or "", matcher)) < least for t in texts], type=pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
