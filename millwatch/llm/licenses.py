"""Short license notices in whole texts, with bounded errors.

A notice with at most k edits, cut into k + 1 pieces, keeps one piece whole.
All pieces of all notices are looked for at once (Aho-Corasick); around each
hit the regex library's bounded-error matching says whether the notice stands
there, where and with how many edits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.llm import common

#: Bytes outside words become spaces; A-Z become a-z.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def folded(text: str) -> str:
    """Lower-case words joined by single spaces."""
    return b" ".join(text.encode().translate(_FOLD).split()).decode()


@dataclass(frozen=True)
class Notice:
    """`text` as folded words, those in brackets without edits, the rest with at most `edits` in all."""

    label: str
    text: str
    edits: int

    @cached_property
    def plain(self) -> str:
        return self.text.replace("[", "").replace("]", "")

    @cached_property
    def seeds(self) -> list[tuple[int, str]]:
        """Offset and text of each of `edits` + 1 pieces."""
        n, k = len(self.plain), self.edits + 1
        cuts = [n * i // k for i in range(k + 1)]
        return [(a, self.plain[a:b]) for a, b in zip(cuts, cuts[1:])]

    @cached_property
    def pattern(self):
        import regex

        parts = []
        for part in re.split(r"(\[[^]]*\])", self.text):
            if part.startswith("["):
                parts.append(regex.escape(part[1:-1], literal_spaces=True))
            elif part:
                parts.append(f"(?:{regex.escape(part, literal_spaces=True)})" + f"{{e<={self.edits}}}" * bool(self.edits))
        return regex.compile(r"(?e)(?<![^ ])" + "".join(parts) + r"(?![^ ])")


#: The phrases of the contract and their labels.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
NOTICES = (
    Notice("mit", "under the [mit] license", 2),
    Notice("apache-2", "[apache] license version [2]", 2),
    Notice("cc-by-nc", "[cc by nc]", 0),
    Notice("cc-by-nc", "creative commons attribution [noncommercial]", 3),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("bsd", "under the [bsd] license", 2),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 8),
    Notice("gpl-2", "[gnu] general public license version [2]", 3),
    Notice("gpl-3", "[gnu] general public license version [3]", 3),
    Notice("mpl-2", "[mozilla] public license version [2]", 3),
)


class Finder:
    """Looks for notices in folded texts."""

    def __init__(self, notices=NOTICES):
        import ahocorasick

        self.notices = tuple(notices)
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(self.notices):
            for offset, piece in notice.seeds:
                pieces.setdefault(piece, []).append((i, offset))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """By notice, the stretches of `text` that can hold it, merged where they meet."""
        found: dict[int, list[list[int]]] = {}
        for last, (size, uses) in self.seeds.iter(text):
            for i, offset in uses:
                notice = self.notices[i]
                start = last + 1 - size - offset
                a, b = max(0, start - notice.edits), min(len(text), start + len(notice.plain) + notice.edits)
                held = found.setdefault(i, [])
                if held and a <= held[-1][1]:  # hits of one seed come in order, and those of a notice's seeds nearly so
                    held[-1][0], held[-1][1] = min(held[-1][0], a), max(held[-1][1], b)
                else:
                    held.append([a, b])
        return found

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in order: exact places, overlapping ones too, and of inexact ones the leftmost that meet no other of the notice."""
        found = []
        for i, stretches in self.windows(text).items():
            notice = self.notices[i]
            exact, inexact, places = [], [], set()
            for a, b in _joined(stretches):
                at = text.find(notice.plain, a, b)
                while at >= 0:
                    end = at + len(notice.plain)
                    if (at == 0 or text[at - 1] == " ") and (end == len(text) or text[end] == " ") and at not in places:
                        places.add(at)
                        exact.append((i, at, end, 0))
                    at = text.find(notice.plain, at + 1, b)
                if notice.edits:
                    for m in notice.pattern.finditer(text, a, b, overlapped=True):
                        if (edits := sum(m.fuzzy_counts)) <= notice.edits:
                            inexact.append((i, m.start(), m.end(), edits))
            found += _apart(exact, inexact)
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def _joined(stretches: list[list[int]]) -> Iterator[tuple[int, int]]:
    held: list[int] | None = None
    for a, b in sorted(stretches):
        if held and a <= held[1]:
            held[1] = max(held[1], b)
        else:
            if held:
                yield held[0], held[1]
            held = [a, b]
    if held:
        yield held[0], held[1]


def _apart(exact: list, inexact: list) -> list:
    """All of `exact`, and of `inexact` in order those that overlap none taken before."""
    taken, k, end = list(exact), 0, 0
    for x in sorted(inexact, key=lambda x: (x[1], x[3], x[2])):
        while k < len(exact) and exact[k][2] <= x[1]:
            k += 1
        if x[1] >= end and (k == len(exact) or exact[k][1] >= x[2]):
            taken.append(x)
            end = x[2]
    return taken


SCHEMA = "doc_id long, n_words long, found array<struct<label:string,notice:int,exact:boolean,first_word:long,words:string,edits:int,likeness:double>>"
_FOUND = pa.struct([
    ("label", pa.string()), ("notice", pa.int32()), ("exact", pa.bool_()), ("first_word", pa.int64()), ("words", pa.string()),
    ("edits", pa.int32()), ("likeness", pa.float64()),
])
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("found", pa.list_(_FOUND))])


def scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """doc_id, n_words, found: one row per row of `docs`, with every notice found in its whole text.

    `found` has the label, the notice's number, whether it stands there without
    edits, the number of its first word, its words as they stand (folded), the
    edits, and 1 - edits / length. Null and empty texts have no words and no
    notice; repeated rows are looked at once per row; an empty table gives no row.
    Work follows the length of the text and of the stretches around its seeds.
    """

    def run(parts):
        finder = Finder(notices)

        def rows(part):
            for doc_id, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                text, found, at, words = folded(raw), [], 0, 0
                for i, start, end, edits in finder.find(text):
                    words += text.count(" ", at, start)
                    at = start
                    notice = finder.notices[i]
                    found.append((notice.label, i, not edits, words, text[start:end], edits, 1 - edits / len(notice.plain)))
                yield doc_id, text.count(" ") + 1 if text else 0, [dict(zip(_NAMES, f)) for f in found]

        for part in common.slices(parts):
            yield from common.batches(rows(part), ARROW, 5000)

    return common.texts(docs).select(F.col(common.DOC), "text").mapInArrow(run, SCHEMA)


_NAMES = [_FOUND.field(i).name for i in range(_FOUND.num_fields)]


def labelled(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, base=BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found.

    Base places are those where a phrase of `base`, which must be a notice, stands
    without edits; the score is the likeness of the best notice, 0 without one.
    """
    numbers = [i for i, n in enumerate(notices) if (n.label, n.plain) in base]
    if len(numbers) != len(base):
        raise ValueError("each base phrase must be one of the notices")
    here = F.filter("found", lambda x: x["exact"] & x["notice"].isin(numbers))
    at = F.transform(here, lambda x: x["first_word"])
    joined = lambda some: F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda x: x["label"]))), ",")
    return scan(docs, notices).select(
        "doc_id", "n_words", F.size(here).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        joined(here).alias("base_labels"), joined(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["likeness"])), F.lit(0.0)).alias("score"), "found",
    )
