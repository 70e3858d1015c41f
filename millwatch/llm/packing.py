"""Hierarchical packing: whole windows first, rests by context-size tier, gaps filled from shorter tiers.

Each task packs the documents it reads, in their order, with bounded pools, so
nothing but the result leaves a task and a retried task gives the same rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.llm import common

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Texts of these characters only go to the faster of two equal encoders. Its pattern goes back step by step over a run of
#: white space, some 600,000 steps deep at most, so texts with a run of `DEEP` go to the other one.
PLAIN = re.compile(r"[\x09\x0a\x0d\x20-\x7e\xa1-\xac\xae-ɏ]*")
DEEP = re.compile(r"\s{10000}")
SPECIAL = "<|endoftext|>"


def encoder(vocabulary: str, ranks: str | None, specials: bool = True) -> Callable[[str], list[int]]:
    """Text to ids of the tokenizer in the file `vocabulary`, without special tokens added.

    `ranks` may name the same vocabulary as ranks; plain texts then go through it.
    Strings of special tokens in a text are those tokens, or plain text unless `specials`.
    """
    import tiktoken
    from tokenizers import Tokenizer

    held: list[Tokenizer] = []

    def exact(text: str) -> list[int]:
        if not held:
            held.append(Tokenizer.from_file(vocabulary))
            held[0].encode_special_tokens = not specials
        return held[0].encode(text, add_special_tokens=False).ids

    if ranks is None:
        return exact
    import public_tokenizers

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def either(text: str) -> list[int]:
        if PLAIN.fullmatch(text) and not DEEP.search(text) and not (specials and SPECIAL in text):
            return fast.encode_ordinary(text)
        return exact(text)

    return either


class Packer:
    """Takes documents as id arrays and gives full windows as lists of pieces (doc, start, ids).

    A rest waits in the pool of the smallest tier that holds it. A window opens
    with the longest waiting rest of its tier; the gap takes the longest waiting
    pieces that fit, from shorter tiers, then the beginning of a waiting piece
    that is cut to measure. Only a gap of the largest tier under `least_cut` ids
    is left open, since all shorter windows are free of padding only when full.
    """

    def __init__(self, tiers=TIERS, pool: int = 256, least_cut: int = 16):
        self.tiers, self.pool, self.least_cut = tuple(sorted(tiers)), pool, least_cut
        self.waiting: dict[int, list] = {t: [] for t in self.tiers}  # (length, number, piece), by length
        self.number = 0

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple[int, list]]:
        top, at = self.tiers[-1], 0
        while len(ids) - at >= top:
            yield top, [(doc, at, ids[at : at + top])]
            at += top
        if at < len(ids):
            yield from self._wait((doc, at, ids[at:]))
        for tier in reversed(self.tiers):
            while len(self.waiting[tier]) > self.pool:
                yield from self._window(tier)

    def _wait(self, piece) -> Iterator[tuple[int, list]]:
        n = len(piece[2])
        if n in self.waiting:  # fills a window of its own
            yield n, [piece]
            return
        tier = next(t for t in self.tiers if t > n)
        self.number += 1
        insort(self.waiting[tier], (n, self.number, piece))

    def _fitting(self, gap: int):
        """The longest waiting piece of at most `gap` ids."""
        for tier in reversed(self.tiers):
            pool = self.waiting[tier]
            k = bisect_right(pool, (gap, float("inf"), None))
            if k:
                return pool.pop(k - 1)[2]
        return None

    def _window(self, tier: int) -> Iterator[tuple[int, list]]:
        pieces, rest = [self.waiting[tier].pop()[2]], None
        gap = tier - len(pieces[0][2])
        while gap:
            piece = self._fitting(gap)
            if piece is None:
                if tier == self.tiers[-1] and gap < self.least_cut:
                    break
                pool = max(self.waiting.values(), key=len)  # the fullest pool gives its longest
                if not pool:
                    break
                doc, start, ids = pool.pop()[2]
                piece, rest = (doc, start, ids[:gap]), (doc, start + gap, ids[gap:])
            pieces.append(piece)
            gap -= len(piece[2])
        yield tier, pieces
        if rest is not None:
            yield from self._wait(rest)

    def close(self) -> Iterator[tuple[int, list]]:
        """Pack what waits: windows as before, then the last tokens, of which at most one window is padded."""
        while any(self.waiting.values()):
            total = sum(n for pool in self.waiting.values() for n, *_ in pool)
            longest = max(pool[-1][0] for pool in self.waiting.values() if pool)
            fit = [t for t in self.tiers if longest < t <= total]
            if fit:
                tier = fit[0]
                home = next(t for t in self.tiers if t > longest)
                if home != tier:
                    self.waiting[tier].append(self.waiting[home].pop())
                yield from self._window(tier)
            elif total >= self.tiers[0]:  # less than the longest's tier: cut it to the largest full tier
                tier = max(t for t in self.tiers if t <= total)
                doc, start, ids = next(pool for pool in self.waiting.values() if pool and pool[-1][0] == longest).pop()[2]
                yield tier, [(doc, start, ids[:tier])]
                yield from self._wait((doc, start + tier, ids[tier:]))
            else:
                pieces = [p for pool in self.waiting.values() for *_, p in pool]
                self.waiting = {t: [] for t in self.tiers}
                yield self.tiers[-1], pieces


class StepGroups:
    """Deals windows of a tier into groups of equal tokens so that attention cost, the sum of squared piece lengths, is even."""

    def __init__(self, tokens: int = 8 * 2048, groups: int = 8):
        self.tokens, self.groups, self.held, self.next = tokens, groups, {}, 0

    def add(self, tier: int, pieces: list) -> Iterator[tuple[int, int, list]]:
        held = self.held.setdefault(tier, [])
        held.append(pieces)
        if len(held) >= self.groups * max(1, self.tokens // tier):
            yield from self.deal(tier)

    def deal(self, tier: int) -> Iterator[tuple[int, int, list]]:
        """(group, tier, pieces): the dearest window first, each round in the opposite order of the last."""
        windows = sorted(self.held.pop(tier, []), key=lambda w: -sum(len(p[2]) ** 2 for p in w))
        n = max(1, common.ceil_div(len(windows), max(1, self.tokens // tier)))
        for i, window in enumerate(windows):
            turn, k = divmod(i, n)
            yield self.next + (n - 1 - k if turn % 2 else k), tier, window
        self.next += n

    def close(self) -> Iterator[tuple[int, int, list]]:
        for tier in sorted(self.held):
            yield from self.deal(tier)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids binary"
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()),
    ("step_group", pa.int64()), ("ids", pa.binary()),
])


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, tiers: tuple[int, ...] = TIERS, with_ids: bool = True) -> DataFrame:
    """One row per piece: where it comes from, the sequence and offset it goes to, its tier, step group and ids.

    A sequence holds at most the largest tier; sequences of shorter tiers are
    full. Texts of any length are encoded whole. Each task leaves at most one
    sequence with a gap beside those of under 16 ids. Null and empty texts are one end id; repeated rows are packed
    once per row; an empty table gives no piece. `ids` holds little-endian
    unsigned 32-bit ids, null unless `with_ids`.
    """

    def run(parts):
        encode = encoder(vocabulary, ranks)
        packer, groups = Packer(tiers), StepGroups(8 * max(tiers))
        base = TaskContext.get().partitionId() << 32
        sequence = 0

        def rows(dealt):
            nonlocal sequence
            for group, tier, pieces in dealt:
                offset = 0
                for (doc_id, n), start, ids in pieces:
                    raw = ids.tobytes()
                    yield doc_id, start, len(ids), zlib.crc32(raw), n, base + sequence, offset, tier, base + group, raw if with_ids else None
                    offset += len(ids)
                sequence += 1

        def windows(part):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = encode(text)
                ids.append(END_ID)
                for tier, pieces in packer.add((doc_id, len(ids)), np.array(ids, dtype="<u4")):
                    yield from groups.add(tier, pieces)

        def last():
            for tier, pieces in packer.close():
                yield from groups.add(tier, pieces)
            yield from groups.close()

        for part in parts:
            yield from common.batches(rows(windows(part)), ARROW, 5000)
        yield from common.batches(rows(last()), ARROW, 5000)

    return common.texts(docs).select(F.col(common.DOC), "text").mapInArrow(run, SCHEMA)
