"""Secret scan: fixed patterns plus values that are hard to guess.

A value that stands in a credential context is cut into words, dates, repeats,
keyboard walks and brute-force spans so that the product of their guesses is
smallest; a value whose smallest product stays high is taken as a secret.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.llm import common

#: The base patterns, in the order of their kinds, and the least length of what counts.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "guess")

#: Where a value is read as a credential, up to the value: wider than the base pattern in keys, joints and characters.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|(?:api|access|private|auth)[_-]?key)"""
    r"""["'`]?[ \t]*(?:[:=]=?>?|->|\bis\b)[ \t]*(?=\S)""",
    re.I | re.A,
)
#: A quoted value, at best with escapes, and what ends no unquoted one.
QUOTED = {q: re.compile(rf"{q}(?:((?:[^{q}\\\n]|\\[^\n])++){q}|([^{q}\n]+){q})") for q in "\"'`"}
UNQUOTED = re.compile(r"\S*")
TRAILING = ".,;:\"'`<>)]}"
#: Words that stand first in the guessing order; the corpus gives the rest.
FIRST_WORDS = (
    "password", "passwd", "admin", "letmein", "welcome", "monkey", "dragon", "master", "login", "secret",
    "changeme", "default", "example", "test", "user", "root", "guest", "hello", "shadow", "sunshine",
    "princess", "football", "baseball", "iloveyou", "trustno", "superman", "batman", "qwerty", "abc", "pass",
    "token", "key", "none", "null", "true", "false", "your", "here", "placeholder", "insert",
)
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")  # the first four lie one below the other
YEAR = re.compile(r"(?:19|20)\d\d")
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
LEET = str.maketrans("013457@$!", "oieastasi")
JOINT = math.log10(2)


def _walks() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    pairs = [pair for row in KEY_ROWS for pair in zip(row, row[1:])]
    for above, below in zip(KEY_ROWS[:3], KEY_ROWS[1:4]):  # a key touches the two above it
        pairs += [*zip(above, below), *zip(above[1:], below)]
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


WALKS = _walks()


def _char_cost(c: str) -> float:
    if c.isdigit():
        return 1.0
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return math.log10(26)
    return math.log10(33) if c.isascii() else math.log10(100)


def guess_cost(value: str, ranks: dict[str, int], longest: int) -> float:
    """log10 of the fewest guesses over all segmentations of `value`.

    Words cost their rank (times two for capitals, times two for digit
    substitutions), dates the days of 119 years, repeats of a unit of any
    length the unit times its count, walks over neighbouring keys their start times length, a space one guess, everything else its
    alphabet to the power of its length. Each further segment doubles the guesses. Empty: 0.
    """
    return suffix_costs(value, ranks, longest)[0]


def suffix_costs(value: str, ranks: dict[str, int], longest: int) -> list[float]:
    """`guess_cost` of value[i:] for every i.

    Units that repeat come from how far value[i:] agrees with value[i+u:] for each
    u: vector steps whose work is the square of the value's length.
    """
    n = len(value)
    lower = value.lower()
    plain = lower.translate(LEET)
    chars = [_char_cost(c) for c in value]
    best = [0.0] * (n + 1)
    rest = np.zeros(n + 1)  # the same with the joint before it, if anything is left
    logs = np.log10(np.maximum(1, np.arange(n + 1)))
    sums = np.concatenate([[0.0], np.cumsum(chars)])
    codes = np.array([ord(c) for c in value], dtype=np.int32)
    units = np.arange(1, n // 2 + 1)
    same = np.zeros(n // 2, dtype=np.int64)  # by unit: how far the value from here agrees with itself one unit on
    brute, walk = math.inf, 1  # the cost with a brute-force span first, the length of the walk that starts here
    for start in range(n - 1, -1, -1):
        brute = chars[start] + min(brute, rest[start + 1])
        low = rest[start + 1] if value[start].isspace() else brute
        for end in range(start + 2, min(n, start + longest) + 1):
            word = lower[start:end]
            rank = ranks.get(word)
            extra = 0.0
            if rank is None:
                rank = ranks.get(plain[start:end])
                extra = JOINT
            if rank is not None:
                if word != value[start:end]:
                    extra += JOINT
                low = min(low, math.log10(rank + 1) + extra + rest[end])
        for m in (DATE.match(value, start), YEAR.match(value, start)):
            if m:
                low = min(low, math.log10(119 if m.end() - start == 4 else 119 * 365) + rest[m.end()])
        ahead = min(n - start - 1, n // 2)
        equal = codes[start + 1 : start + 1 + ahead] == codes[start]
        same[:ahead] = (same[:ahead] + 1) * equal
        repeated = units[: (n - start) // 2]
        repeated = repeated[same[: len(repeated)] >= repeated]
        while len(repeated):
            unit = int(repeated[0])
            reach = unit + int(same[unit - 1])
            least = 3 if unit == 1 else 2
            if reach // unit >= least:
                tails = rest[start + unit * least : start + reach + 1 : unit]
                low = min(low, sums[start + unit] - sums[start] + float((tails + logs[least : least + len(tails)]).min()))
            repeated = repeated[1:]  # and no multiple that is itself a repeat of this unit, which costs less
            repeated = repeated[(repeated % unit != 0) | (repeated > reach)]
        walk = walk + 1 if start < n - 1 and lower[start + 1] in WALKS.get(lower[start], ()) else 1
        if walk >= 3:
            low = min(low, math.log10(36 * 2) + float((rest[start + 3 : start + walk + 1] + logs[3 : walk + 1]).min()))
        best[start] = float(low)
        rest[start] = low + JOINT
    return best


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base matches, by start, then kind."""
    spans = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def guessed_spans(text: str, ranks: dict[str, int], longest: int, least: float) -> list[tuple[int, int, float]]:
    """(start, end, log10 guesses) of credential values that cost at least 10**least guesses.

    A quoted value runs to its closing quote, any other to white space, without
    trailing punctuation unless too little is left. A context inside a value
    counts too; values that end alike are priced together.
    """
    found = []
    run_end, end, base, costs = 0, 0, 0, None
    for m in CONTEXT.finditer(text):
        start = m.end()
        quoted = QUOTED[text[start]].match(text, start) if text[start] in QUOTED else None
        if quoted:
            start, stop = quoted.span(quoted.lastindex)
            if stop - start < LEAST_VALUE:
                continue
            cost = guess_cost(text[start:stop], ranks, longest)
        else:
            start += text[start] in QUOTED
            if start >= run_end:
                run_end, costs = UNQUOTED.match(text, start).end(), None
                end = start + len(text[start:run_end].rstrip(TRAILING))
            stop = end
            if stop - start < LEAST_VALUE:
                stop = start + len(text[start:run_end].rstrip(TRAILING[0]))
                if stop - start < LEAST_VALUE:
                    continue
                cost = guess_cost(text[start:stop], ranks, longest)
            else:
                if costs is None:
                    base, costs = start, suffix_costs(text[start:stop], ranks, longest)
                cost = costs[start - base]
        if cost >= least:
            found.append((start, stop, cost))
    return found


def joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind, *_ in spans)


def frequent_words(docs: DataFrame, most: int = 5000) -> list[str]:
    """The `most` most frequent lower-case words of 4 to 20 letters over all documents, in falling order.

    `most` is the size of a guesser's word list: it bounds what reaches the
    driver. Words that occur once are in no such list.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(parts):
        held: Counter[str] = Counter()
        for part in parts:
            for text in part.column(0).to_pylist():
                held.update(w for w in text.lower().split() if 4 <= len(w) <= 21)
                if len(held) > 200_000:  # bounded memory: partial sums go on
                    yield from common.batches(held.items(), schema)
                    held = Counter()
        yield from common.batches(held.items(), schema)

    counted = (
        common.texts(docs).select("text").mapInArrow(count, "word string, n long")
        .withColumn("word", F.regexp_replace("word", r"[.,;:!?]+$", ""))
        .filter(F.col("word").rlike(r"^\p{L}{4,20}$"))
        .groupBy("word").agg(F.sum("n").alias("n"))
    )
    counted = common.stored(counted.filter("n > 1"), "words")
    # counts by powers of two tell a bound that few words more than wanted reach
    powers = {r["power"]: r["words"] for r in counted.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("words")).collect()}
    reached, least = 0, 0
    for least in sorted(powers, reverse=True):
        reached += powers[least]
        if reached >= most:
            break
    frequent = counted.filter(F.floor(F.log2("n")) >= least)
    return [r["word"] for r in frequent.orderBy(F.desc("n"), "word").limit(most).collect()]


def scan(docs: DataFrame, words: list[str] = (), least_log10: float = 8.0) -> DataFrame:
    """One row per document with its secrets.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess,
    max_log10_guesses. Positions count code points of the whole text; null and
    empty texts give no span, a repeated row gives its row again, an empty table
    an empty result. Extra columns are not looked at.
    """
    ranks: dict[str, int] = {}
    for w in (*FIRST_WORDS, *words):
        ranks.setdefault(w.lower(), len(ranks) + 1)
    longest = max(map(len, ranks))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
         ("base_sha256", pa.string()), ("spans", pa.string()), ("n_guess", pa.int64()), ("max_log10_guesses", pa.float64())]
    )

    def row(doc_id, text):
        base = base_spans(text)
        added = guessed_spans(text, ranks, longest, least_log10)
        spans = sorted([*base, *((s, e, 3) for s, e, _ in added)], key=lambda s: (s[0], s[2]))
        kinds = Counter(k for _, _, k in spans)
        digest = hashlib.sha256(joined(base).encode()).hexdigest()
        return doc_id, kinds[0], kinds[1], kinds[2], digest, joined(spans), kinds[3], max((c for *_, c in added), default=None)

    def run(parts):
        for part in parts:
            ids, found = part.column(0).to_pylist(), part.column(1).to_pylist()
            yield from common.batches(map(row, ids, found), schema)

    return common.texts(docs).select(common.DOC, "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, max_log10_guesses double"
    )
