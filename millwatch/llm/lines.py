"""Line dedup: lines that many documents share stay in one document only.

Line hashes are range-partitioned with a secondary sort by document, so that a
run of equal hashes is read as a stream whose first document is the keeper. A
run may go on in the next partition: what touches a partition's edge is settled
by one verdict per edge hash. What leaves the operator is a compressed bitmap of
kept lines per document, no text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.llm import common
from millwatch.session import materialise

#: What is stripped from a line's ends.
SPACES = " \t\n\x0b\x0c\r"


def line_key(line: str) -> str:
    """The line without space at its ends, A-Z in lower case."""
    key = line.strip(SPACES)
    return key.lower() if key.isascii() else key.encode().lower().decode()


def key_hash(key: str) -> bytes:
    return xxhash.xxh3_128_digest(key)


_RUN = "__hash binary, __doc long, __mark long, lines array<int>, n_lines int"
_RUN_ARROW = pa.schema([("__hash", pa.binary()), ("__doc", pa.int64()), ("__mark", pa.int64()), ("lines", pa.list_(pa.int32())), ("n_lines", pa.int32())])


def occurrences(docs: DataFrame, least_chars: int) -> DataFrame:
    """One row per document and key that is long enough, with the numbers of its lines."""

    def run(parts):
        def rows(part):
            for doc, mark, text in zip(*(column.to_pylist() for column in part.columns)):
                lines = text.split("\n")
                found: dict[bytes, list[int]] = {}
                for i, line in enumerate(lines):
                    if len(line) >= least_chars and len(key := line_key(line)) >= least_chars:
                        found.setdefault(key_hash(key), []).append(i)
                for h, places in found.items():
                    yield h, doc, mark, places, len(lines)

        for part in parts:
            yield from common.batches(rows(part), _RUN_ARROW)

    return common.texts(docs).mapInArrow(run, _RUN)


def _stream(least_docs: int):
    """Settle runs inside a partition; `closed` rows are dropped lines, open rows wait for the verdict on their hash."""
    schema = pa.schema([*_RUN_ARROW, pa.field("closed", pa.bool_())])

    def settle(rows):
        current, first_run = None, True
        held: list[tuple] = []  # rows of the run's first documents, while it has too few
        docs: list = []  # its first documents, the keeper first
        last = None
        for row in rows:
            h, doc, mark = row[0], row[1], row[2]
            if h != current:
                first_run = current is None
                current, held, docs, last = h, [], [], None
            if (doc, mark) == last:  # a repeated row: its lines are known
                continue
            last = (doc, mark)
            if len(docs) < least_docs and (not docs or docs[-1] != doc):
                docs.append(doc)
                reached = len(docs) == least_docs
            else:
                reached = False
            if first_run:  # it may have begun in an earlier partition
                yield (*row, False)
            elif len(docs) < least_docs:
                held.append(row)
            else:
                if reached:
                    yield from ((*r, True) for r in held if r[1] != docs[0])
                    held = []
                if doc != docs[0]:
                    yield (*row, True)
        if current is not None and not first_run:  # it may go on in a later partition
            yield from ((*r, False) for r in held)
            if not held:
                yield from ((current, doc, None, None, None, False) for doc in docs)

    def run(parts):
        def rows():
            for part in parts:
                yield from zip(*(column.to_pylist() for column in part.columns))

        yield from common.batches(settle(rows()), schema, 5000)

    return run


def dropped_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """Document key, dropped line numbers and number of lines, a row per key that loses its lines there."""
    found = materialise(occurrences(docs, least_chars))
    # the document is part of the range, so one hash may fill many partitions
    order = ["__hash", F.desc_nulls_last("__doc"), "__mark"]
    settled = materialise(
        found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream(least_docs), _RUN + ", closed boolean")
    )
    waiting = settled.filter("not closed")
    verdicts = (
        waiting.groupBy("__hash").agg(
            (F.countDistinct("__doc") + F.max(F.col("__doc").isNull().cast("int"))).alias("n_docs"), F.max("__doc").alias("keeper")
        ).filter(F.col("n_docs") >= least_docs).select("__hash", "keeper")
    )
    # at most two hashes for each partition of the stream
    late = waiting.filter("lines is not null").join(F.broadcast(verdicts), "__hash").filter(~F.col("__doc").eqNullSafe(F.col("keeper")))
    columns = [common.DOC, common.MARK, "lines", "n_lines"]
    return settled.filter("closed").select(*columns).unionByName(late.select(*columns))


def keep_bitmaps(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """Document key, n_lines, n_dropped and `keep`, a compressed bitmap with a bit per line, for documents that lose lines."""

    def bitmap(parts):
        schema = pa.schema([("__doc", pa.int64()), ("__mark", pa.int64()), ("n_lines", pa.int32()), ("n_dropped", pa.int32()), ("keep", pa.binary())])

        def rows(part):
            for doc, mark, n, lines in zip(*(column.to_pylist() for column in part.columns)):
                keep = np.ones(n, dtype=bool)
                for some in lines:
                    keep[some] = False
                yield doc, mark, n, int(n - keep.sum()), zlib.compress(np.packbits(keep).tobytes())

        for part in parts:
            yield from common.batches(rows(part), schema)

    grouped = dropped_lines(docs, least_chars, least_docs).groupBy(common.DOC, common.MARK).agg(
        F.max("n_lines").alias("n_lines"), F.collect_list("lines").alias("lines")
    )
    return grouped.mapInArrow(bitmap, "__doc long, __mark long, n_lines int, n_dropped int, keep binary")


def kept_lines(text: str, keep: bytes | None) -> tuple[str, int, int]:
    """The text's kept lines joined again, the number of its lines and of those dropped."""
    lines = text.split("\n")
    if keep is None:
        return text, len(lines), 0
    flags = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), count=len(lines))
    kept = [line for line, flag in zip(lines, flags) if flag]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def with_bitmaps(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, *more) -> DataFrame:
    rows, bitmaps = common.texts(docs, *more), keep_bitmaps(docs, least_chars, least_docs)
    return rows.join(bitmaps, common.same_document(rows, bitmaps), "left").drop(bitmaps[common.DOC], bitmaps[common.MARK])


def digests(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256: one row per row of `docs`.

    Null and empty texts are one empty line, which is too short to go. Rows that
    repeat an id are one document; a null id is the smallest document. An empty
    table gives no row.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def run(parts):
        def rows(part):
            for doc, text, keep in zip(*(column.to_pylist() for column in part.columns)):
                kept, n, dropped = kept_lines(text, keep)
                yield doc, n, dropped, hashlib.sha256(kept.encode()).hexdigest()

        for part in parts:
            yield from common.batches(rows(part), schema)

    return with_bitmaps(docs, least_chars, least_docs).select(common.DOC, "text", "keep").mapInArrow(
        run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    )


def dedup(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """`docs` with the kept lines as text and, where there is such a column, their length as n_chars."""
    rows, names = common.numbered(docs)
    text = names["text"]

    def run(parts):
        for part in parts:
            columns = dict(zip(part.schema.names, part.columns))
            keep = columns.pop("keep").to_pylist()
            kept = [None if t is None else kept_lines(t, k)[0] for t, k in zip(columns[text].to_pylist(), keep)]
            columns[text] = pa.array(kept, type=columns[text].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    bitmaps, marked = keep_bitmaps(docs, least_chars, least_docs), common.keyed(rows, names)
    joined = marked.join(bitmaps, common.same_document(marked, bitmaps), "left").select(*names.values(), "keep")
    result = joined.mapInArrow(run, rows.schema).toDF(*docs.columns)
    return result.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else result
