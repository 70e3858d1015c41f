"""Alignment of two tokenizers over whole texts.

Each tokenization of a text is a sparse token-byte matrix in compressed rows.
The row products A * B^T link tokens that share bytes; products of the
token-group matrices link tokens of one group, the stretches between byte
offsets where tokens of both end. How many documents hold a pair of ids linked
is counted over the corpus and given back to the documents.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.llm import common, packing

#: Link entries of documents that are counted and scored together; one longer document is a batch of its own.
BATCH = 1_000_000
#: Products are taken for so many expanded entries at a time.
BLOCK = 1 << 20


@dataclass(frozen=True)
class Sparse:
    """A matrix in compressed rows: `indices[indptr[i]:indptr[i + 1]]` are the columns of row i, `data` their values."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    @classmethod
    def ones(cls, indptr: np.ndarray, indices: np.ndarray, columns: int) -> Sparse:
        return cls(indptr, indices, np.ones(len(indices), dtype=np.int64), columns)

    def transposed(self) -> Sparse:
        """Entries counted by column, then placed in the order of their rows."""
        indptr = np.zeros(self.columns + 1, dtype=np.int64)
        np.cumsum(np.bincount(self.indices, minlength=self.columns), out=indptr[1:])
        order = np.argsort(self.indices, kind="stable")
        return Sparse(indptr, np.repeat(np.arange(self.rows), np.diff(self.indptr))[order], self.data[order], self.rows)

    def work(self, other: Sparse) -> np.ndarray:
        """Entries of `other` that each row of this one reaches: what its row of the product is summed from."""
        reached = np.r_[0, np.cumsum(np.diff(other.indptr)[self.indices])]
        return reached[self.indptr[1:]] - reached[self.indptr[:-1]]

    def reach(self, other: Sparse) -> np.ndarray:
        """For each entry, how many the transposed of `other` has in the row it names."""
        return np.bincount(other.indices, minlength=other.columns)[self.indices]

    def times(self, other: Sparse, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Gustavson's product by rows: row i is the sum of the rows of `other` that row i names.

        Gives (row, column, value) in order, for blocks of whole rows that reach
        about `block` entries. A row that reaches more is a block of its own.
        """
        work = np.r_[0, np.cumsum(self.work(other))]
        at = 0
        while at < self.rows:
            end = max(at + 1, int(np.searchsorted(work, work[at] + block, side="right")) - 1)
            yield self._rows(other, at, end)
            at = end

    def _rows(self, other: Sparse, at: int, end: int):
        a, b = self.indptr[at], self.indptr[end]
        named = self.indices[a:b]
        sizes = other.indptr[named + 1] - other.indptr[named]
        row = np.repeat(np.repeat(np.arange(at, end), np.diff(self.indptr[at : end + 1])), sizes)
        total = int(sizes.sum())
        place = np.arange(total) + np.repeat(other.indptr[named] - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
        column, value = other.indices[place], np.repeat(self.data[a:b], sizes) * other.data[place]
        key = row * other.columns + column
        if not total:
            return row, column, value
        step = key[1:] - key[:-1]
        if step.min(initial=0) < 0:
            order = np.argsort(key, kind="stable")
            row, column, value = row[order], column[order], value[order]
            step = np.diff(key[order])
        first = np.r_[0, np.flatnonzero(step) + 1]
        return row[first], column[first], np.add.reduceat(value, first)


@dataclass(frozen=True)
class Aligned:
    """Two tokenizations of the same bytes: ids, and the byte offset at which each token ends."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray

    @staticmethod
    def incidence(ends: np.ndarray) -> Sparse:
        """Tokens against the bytes they cover."""
        n = int(ends[-1]) if len(ends) else 0
        return Sparse.ones(np.r_[0, ends], np.arange(n), n)

    @cached_property
    def shared_ends(self) -> np.ndarray:
        """Byte offsets where tokens of both end; each ends a group."""
        return self.a_ends[self.b_ends[np.searchsorted(self.b_ends, self.a_ends)] == self.a_ends]

    @cached_property
    def a_groups(self) -> Sparse:
        """Tokens of A against their group."""
        return self._grouped(self.a_ends)

    @cached_property
    def b_groups(self) -> Sparse:
        return self._grouped(self.b_ends)

    def _grouped(self, ends: np.ndarray) -> Sparse:
        return Sparse.ones(np.arange(len(ends) + 1), np.searchsorted(self.shared_ends, ends), len(self.shared_ends))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token of A, token of B and shared bytes of each overlap."""
        found = list(self.incidence(self.a_ends).times(self.incidence(self.b_ends).transposed()))
        if not found:
            return (np.empty(0, dtype=np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))

    def group_links(self, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same of tokens in one group, in blocks: a long group has the product of its sizes."""
        yield from self.a_groups.times(self.b_groups.transposed(), block)

    def n_group_links(self) -> int:
        """Their number, from the sizes of the rows: groups are disjoint, so no two entries are one link."""
        return int(self.a_groups.reach(self.b_groups).sum())


class Aligner:
    """Encodes texts with both tokenizers and keeps what covers the same bytes."""

    def __init__(self, vocabulary: str, pieces: str, ranks: str | None = None):
        import sentencepiece

        self.encode_a = packing.encoder(vocabulary, ranks, specials=False)
        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.bytes_a, self.bytes_b = byte_entries(vocabulary), piece_entries(self.model)
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in entries], dtype=np.int64) for entries in (self.bytes_a, self.bytes_b))
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        spelled = lambda n, end: [f"{i}{sign}".encode() for sign in ("," + end) for i in range(n)]
        #: Each id before a comma and as the last of its side in a group; shorter ones are filled up with zero bytes.
        self.said_a, self.said_b = np.array(spelled(n_a, "|")), np.array(spelled(n_b, ";"))

    def align(self, text: str) -> Aligned | None:
        """None if the text is empty or either tokenizer changes its bytes."""
        if not text:
            return None
        whole = " " + text
        a, b, raw = self.encode_a(whole), self.model.encode(text), whole.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        return Aligned(a, b, np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b]))

    def said(self, found: Aligned) -> bytes:
        """Groups as text: ids of A, a bar, ids of B, with a semicolon between groups."""
        group_a, group_b = found.a_groups.indices, found.b_groups.indices
        last_a, last_b = (np.r_[g[1:] != g[:-1], True] for g in (group_a, group_b))
        words = np.empty(len(group_a) + len(group_b), dtype=max(self.said_a.dtype, self.said_b.dtype))
        # a token follows those of its side, and the other side's of earlier groups (of its own, too, for B)
        words[np.arange(len(group_a)) + np.searchsorted(group_b, group_a, side="left")] = self.said_a[found.a + len(self.bytes_a) * last_a]
        words[np.arange(len(group_b)) + np.searchsorted(group_a, group_b, side="right")] = self.said_b[found.b + len(self.bytes_b) * last_b]
        return words.tobytes().translate(None, b"\0")[:-1]


def byte_entries(vocabulary: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary file, whose entries write bytes as characters.

    Printable bytes of Latin-1 stand for themselves, the others, in order, for the characters from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    with open(vocabulary, encoding="utf-8") as file:
        held = json.load(file)
    entries = held["model"]["vocab"] | {x["content"]: x["id"] for x in held["added_tokens"]}
    found = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        found[i] = bytes(byte[c] for c in entry)
    return found


def piece_entries(model) -> list[bytes]:
    """Bytes of each piece: byte pieces their byte, others their text with U+2581 as a space."""
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]


_TASK = pa.schema([
    ("batch", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("sha256", pa.list_(pa.string())),
    ("keys", pa.binary()), ("n_docs", pa.binary()), ("links", pa.binary()),
])
_TASK_SQL = "batch long, doc_id array<long>, counts array<long>, sha256 array<string>, keys binary, n_docs binary, links binary"
_COUNTS = 5  # n_a, n_b, n_groups, n_links, n_group_links


def _blob(values: np.ndarray, kind: str) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values, dtype=kind).tobytes(), 1)


def _values(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), dtype=kind)


class Batch:
    """Documents whose distinct linked pairs are numbered together."""

    def __init__(self):
        self.docs, self.counts, self.said, self.keys, self.times, self.size = [], [], [], [], [], 0

    def add(self, doc_id, counts, said, keys, times):
        self.docs.append(doc_id)
        self.counts += counts
        self.said.append(said)
        self.keys.append(keys)
        self.times.append(times)
        self.size += len(keys)

    def row(self, number: int):
        """The batch's pairs in ascending order, the documents that hold each, and each document's pairs as numbers among them."""
        keys, places = np.unique(np.concatenate(self.keys), return_inverse=True)
        sizes = np.array([len(k) for k in self.keys])
        # ascending within a document: steps are small, a document's first is counted from zero
        steps = np.diff(places, prepend=0)
        firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
        steps[firsts] = places[firsts]
        links = np.concatenate([sizes, steps, *self.times])
        return number, self.docs, self.counts, self.said, _blob(np.diff(keys, prepend=0), "<i8"), _blob(np.bincount(places, minlength=len(keys)), "<u4"), _blob(links, "<u4")


def _opened(n: int, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first entry of each document and the end, pair numbers, times) of a batch of n documents."""
    values = _values(blob, "<u4").astype(np.int64)
    sizes, rest = values[:n], values[n:]
    steps, times = rest[: len(rest) // 2], rest[len(rest) // 2 :]
    indptr = np.r_[0, np.cumsum(sizes)]
    run = np.r_[0, np.cumsum(steps)]
    return indptr, run[1:] - np.repeat(run[indptr[:-1]], sizes), times


def batched(docs: DataFrame, vocabulary: str, pieces: str, ranks: str | None = None, size: int = BATCH) -> DataFrame:
    """One row per batch of documents: ids, counts, group digests, and linked id pairs (A id * size of B + B id) with their times."""

    def run(parts):
        aligner, number, held = Aligner(vocabulary, pieces, ranks), TaskContext.get().partitionId() << 32, Batch()
        n_b = len(aligner.bytes_b)
        none = np.empty(0, dtype=np.int64)

        def rows(part):
            nonlocal held, number
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found = aligner.align(text)
                if found is None:
                    held.add(doc_id, [0] * _COUNTS, "", none, none)
                else:
                    i, j, _ = found.links()
                    keys, times = np.unique(found.a[i] * n_b + found.b[j], return_counts=True)
                    counts = [len(found.a), len(found.b), len(found.shared_ends), len(i), found.n_group_links()]
                    held.add(doc_id, counts, hashlib.sha256(aligner.said(found)).hexdigest(), keys, times)
                if held.size >= size or len(held.docs) >= 50_000:
                    yield held.row(number)
                    held, number = Batch(), number + 1

        for part in common.slices(parts):
            for row in rows(part):
                yield from common.batches([row], _TASK)
        if held.docs:
            yield from common.batches([held.row(number)], _TASK)

    return common.texts(docs).select(F.col(common.DOC), "text").mapInArrow(run, _TASK_SQL)


def _pairs(found: DataFrame) -> DataFrame:
    """batch, place, key, n_docs: the distinct pairs of each batch."""
    schema = pa.schema([("batch", pa.int64()), ("place", pa.int32()), ("key", pa.int64()), ("n_docs", pa.int64())])

    def run(parts):
        for part in parts:
            for batch, keys, n_docs in zip(*(column.to_pylist() for column in part.columns)):
                keys, n_docs = np.cumsum(_values(keys, "<i8")), _values(n_docs, "<u4").astype(np.int64)
                columns = [np.full(len(keys), batch), np.arange(len(keys), dtype=np.int32), keys, n_docs]
                for at in range(0, len(keys), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 50_000]) for c in columns], schema=schema)

    return found.select("batch", "keys", "n_docs").mapInArrow(run, "batch long, place int, key long, n_docs long")


def pair_counts(found: DataFrame, n_b: int) -> DataFrame:
    """key, total, best: in how many documents each linked pair stands, and whether no pair of its A id stands in more."""
    counts = found.groupBy("key").agg(F.sum("n_docs").alias("n_docs")).withColumn("a", ((F.col("key") - F.pmod("key", F.lit(n_b))) / n_b).cast("int"))
    highest = counts.groupBy("a").agg(F.max("n_docs").alias("highest"))
    # at most one row per id of the vocabulary
    return counts.join(F.broadcast(highest), "a").select("key", F.col("n_docs").alias("total"), (F.col("n_docs") == F.col("highest")).alias("best"))


def align(docs: DataFrame, vocabulary: str, pieces: str, ranks: str | None = None, size: int = BATCH) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_group_links: one row per row of `docs`.

    A (byte-level, file `vocabulary`) encodes a space and the text, B (file
    `pieces`) the text, to which it adds that space; special tokens are plain
    text. Null and empty texts, and those whose bytes a tokenizer changes, have
    zeros and an empty digest. Every row counts as a document, repeated rows too;
    an empty table gives no row.

    Texts are encoded once. A task counts its pairs by batches, so that what is
    shuffled are the distinct pairs of batches, not the links of documents.
    """
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    found = common.stored(batched(docs, vocabulary, pieces, ranks, size), "alignment")
    pairs = _pairs(found)
    counted = pairs.join(pair_counts(pairs, n_b), "key").select("batch", "place", "total", "best")
    schema = pa.schema([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in COLUMNS])

    def run(batches: pa.Table, scores: pa.Table) -> pa.Table:
        tables = []
        place = scores.column("place").to_numpy()
        count, best = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
        count[place], best[place] = scores.column("total").to_numpy(), scores.column("best").to_numpy().astype(np.int64)
        for row in batches.to_pylist():
            n = len(row["doc_id"])
            indptr, pair, times = _opened(n, row["links"])
            sums = [np.r_[0, np.cumsum(times * x[pair])] for x in (best, count)]
            n_best, count_sum = (s[indptr[1:]] - s[indptr[:-1]] for s in sums)
            counts = np.array(row["counts"], dtype=np.int64).reshape(n, _COUNTS).T
            columns = [row["doc_id"], *counts[:4], n_best, count_sum, row["sha256"], counts[4]]
            tables.append(pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema))
        return pa.concat_tables(tables) if tables else schema.empty_table()

    left = found.select("batch", "doc_id", "counts", "sha256", "links").groupBy("batch")
    return left.cogroup(counted.groupBy("batch")).applyInArrow(run, ", ".join(f"{n} {'string' if n == 'groups_sha256' else 'long'}" for n in COLUMNS))


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links")


def links(docs: DataFrame, vocabulary: str, pieces: str, ranks: str | None = None) -> DataFrame:
    """doc_id, a_ids, b_ids, group_ends, links: both tokenizations, the bytes where groups end, and token numbers and shared bytes of each overlap."""
    link = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n_bytes", pa.int32())])
    schema = pa.schema([
        ("doc_id", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())), ("group_ends", pa.list_(pa.int64())), ("links", pa.list_(link))
    ])

    def run(parts):
        aligner = Aligner(vocabulary, pieces, ranks)

        def rows(part):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found = aligner.align(text)
                if found is None:
                    yield doc_id, [], [], [], []
                else:
                    yield doc_id, found.a.tolist(), found.b.tolist(), found.shared_ends.tolist(), [dict(zip(("a", "b", "n_bytes"), x)) for x in zip(*(v.tolist() for v in found.links()))]

        for part in common.slices(parts, 64):
            yield from common.batches(rows(part), schema, 64)

    return common.texts(docs).select(F.col(common.DOC), "text").mapInArrow(
        run, "doc_id long, a_ids array<int>, b_ids array<int>, group_ends array<long>, links array<struct<a:int,b:int,n_bytes:int>>"
    )
