"""Small tables with every awkward case, shared by the tests."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use names like, or that only look like theirs.
CLASHES = "spans string, size long, n_rows long, whole long, keep string, fp long, score double, copies long, component_id long, block long, `number` long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))


def rows(n: int = 60, seed: int = 1) -> list[tuple]:
    """Texts with shared passages and lines, exact and near copies, nulls in every column, empty and very long texts, repeated rows."""
    rng = random.Random(seed)
    passage, line = words(rng, 120), words(rng, 12)
    found = []
    for i in range(n):
        parts = [words(rng, rng.randint(1, 90)) for _ in range(rng.randint(1, 4))]
        if i % 4 == 0:
            parts.insert(rng.randint(0, len(parts)), passage[rng.randint(0, 150) : rng.randint(600, len(passage))])
        if i % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), rng.choice(["", "  ", "\t"]) + rng.choice([line, line.upper(), line.title()]))
        text = "\n".join(parts)
        found.append((i, text, "en", f"src{i % 5}", len(text)))
    copies = [(n + k, found[k * 7 % n][1] + (" changed" if k % 2 else ""), "en", "src0", None) for k in range(12)]
    odd = [
        (n + 20, None, "en", "src1", None), (n + 21, "", None, None, 0), (n + 22, " \t\n\n ", "de", "", 5), (None, words(rng, 30), None, None, None),
        (n + 23, "a" * 1500, "en", "src2", 1500), (n + 24, "ab" * 700 + "ü€😀" * 200, "fr", "src2", None), (n + 25, words(rng, 4000), "en", "src3", None),
        (n + 26, "Ünïcödé " * 90, "fr", "src4", None),
    ]
    found += copies + odd
    return found + [found[4], found[4], found[9], odd[3], odd[0]]  # repeated rows


def table(spark, data, clashes: bool = True):
    extra = (None, 5, None, 2, "x", 3, 0.5, None, 9, 1, 4)
    if clashes:
        return spark.createDataFrame([(*r, *extra) for r in data], f"{DOCS}, {CLASHES}").repartition(3)
    return spark.createDataFrame(data, DOCS)


def empty(spark):
    return spark.createDataFrame([], f"{DOCS}, {CLASHES}")


def sorted_rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
