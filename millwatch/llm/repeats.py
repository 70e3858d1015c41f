"""Repeated byte strings, found by refining buckets of text positions.

Suffixes are sampled so that equal strings are sampled alike: each window of
`length` bytes names the position of its smallest q-gram hash (the leftmost of
equals). Initial buckets hold the positions of one q-gram. Each round sorts the
members of a bucket on the identifier of the text at later (and earlier)
offsets; who then has an equal neighbour is settled with all its windows, who
is alone in its bucket has no repeat, and the others go on with buckets of
narrower ranges of windows, down to a single window, together with a witness
of each settled kind in their bucket. Identifiers are 64-bit
hashes, two of which agree before a byte is removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwatch.llm import common

#: Fixed value: the length of what counts as a repeat, in bytes.
LENGTH = 400
GRAM = 200
#: Windows per node in the rounds after the first; each width divides the one
#: before, so that no window belongs to two nodes of a position. The offset of a
#: window's sampled position is below 2**8, as nodes hold it in a byte.
WIDTHS = (36, 6, 1)
_SLICE = 1 << 20
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_hash = xxhash.xxh3_64_intdigest


def gram_hashes(data: bytes, q: int) -> np.ndarray:
    """A hash of each q-gram (q >= 8): eight bytes as a number, then pairs of equal halves, doubled until q is reached."""
    n = len(data)
    h = np.empty(n - 7, dtype=np.uint64)
    for j in range(8):
        h[j::8] = np.frombuffer(data, "<u8", (n - j) // 8, j)
    h *= _ODD[0]
    h ^= h >> np.uint64(31)
    span = 8
    while span < q:
        step = min(span, q - span)
        h = (h[: len(h) - step] * _ODD[1] + h[step:]) * _ODD[2]
        h ^= h >> np.uint64(29)
        span += step
    return h


def sampled(data: bytes, length: int = LENGTH, q: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions, their q-gram hashes, and the first and last window that names each."""
    if len(data) < length:
        return (np.empty(0, dtype=np.int64),) * 4
    found = []
    for at in range(0, len(data) - length + 1, _SLICE):
        h = gram_hashes(data[at : at + _SLICE + length - 1], q)
        low = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        span, width = 1, length - q + 1
        while span < width:
            step = min(span, width - span)
            low = np.minimum(low[: len(low) - step], low[step:])
            span += step
        named = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, named[1:] != named[:-1]])
        last = np.r_[first[1:], len(named)] - 1
        found.append((named[first] + at, h[named[first]].view(np.int64), first + at, last + at))
    at, grams, first, last = (np.concatenate(x) for x in zip(*found))
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])  # a position that two slices name is one
    return at[new], grams[new], first[new], last[np.r_[new[1:] - 1, len(at) - 1]]


# A node is a position, the offsets of the windows that name it, and the first offset of the node's range
def pack_node(position, least, most, low=0):
    return position << 24 | least << 16 | most << 8 | low


def unpack_node(node):
    return node >> 24, node >> 16 & 255, node >> 8 & 255, node & 255


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def scan(docs: DataFrame, length: int = LENGTH, q: int = GRAM) -> DataFrame:
    """One row per document: number, key, size, digest, and its sampled nodes with q-gram and context identifiers."""
    schema = pa.schema([
        ("number", pa.int64()), ("__doc", pa.int64()), ("__mark", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string()),
        ("nodes", pa.list_(pa.int64())), ("coarse", pa.list_(pa.int64())), ("fine", pa.list_(pa.int64())),
    ])

    def run(parts):
        number = TaskContext.get().partitionId() << 33
        reach = length - q

        def rows(part):
            nonlocal number
            for doc, mark, text in zip(*(column.to_pylist() for column in part.columns)):
                data = text.encode()
                at, grams, first, last = sampled(data, length, q)
                around = []
                for a in at.tolist():
                    left, right = min(a, reach), min(length, len(data) - a)
                    around.append(_signed(_hash(data[a - left : a + right], left << 10 | right)))
                yield number, doc, mark, len(data), hashlib.sha256(data).hexdigest(), pack_node(at, at - last, at - first).tolist(), grams.tolist(), around
                number += 1

        for part in parts:
            yield from common.batches(rows(part), schema, 500)

    return common.texts(docs).mapInArrow(
        run, "number long, __doc long, __mark long, n_bytes long, sha256 string, nodes array<long>, coarse array<long>, fine array<long>"
    )


def settle(rows: DataFrame, name: str) -> DataFrame:
    """number, node, settled, open of `rows` (number, node, coarse, fine) whose coarse bucket has other members.

    Open are those that go on: not settled, or settled beside others of their
    bucket that may still equal them in part.

    Rows are range-sorted by bucket and refined identifier, so one large bucket
    may fill many partitions and neighbours tell all there is to know: a row is
    settled if a neighbour has both its identifiers. Only the first and last
    row of a partition have a neighbour elsewhere; they are compared among
    themselves, two rows for each partition.
    """
    order = ["coarse", "fine", "number", "node"]
    schema = pa.schema([("number", pa.int64()), ("node", pa.int64()), ("coarse", pa.int64()), ("fine", pa.int64()), ("shared", pa.bool_()), ("settled", pa.bool_()), ("open", pa.bool_()), ("edge", pa.bool_())])

    def run(parts):
        held = None  # the last row, whose next one is unknown

        def emit(block, edge_first, edge_last):
            """Rows of `block` but its first and last, which only give context unless they are the partition's own."""
            number, node, coarse, fine = block
            bucket = coarse[1:] == coarse[:-1]
            equal = bucket & (fine[1:] == fine[:-1])
            shared, settled, mixed = (np.zeros(len(number), dtype=bool) for _ in range(3))
            for flags, pairs in ((shared, bucket), (settled, equal), (mixed, bucket & ~equal)):
                flags[1:] |= pairs
                flags[:-1] |= pairs
            edge = np.zeros(len(number), dtype=bool)
            edge[0], edge[-1] = edge_first, edge[-1] or edge_last
            edge[0] |= edge_last and len(number) == 1
            keep = shared | edge
            keep[0] &= edge_first
            keep[-1] &= edge_last or (edge_first and len(number) == 1)
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (number, node, coarse, fine, shared, settled, ~settled | mixed | edge, edge)], schema=schema)

        first = True
        for part in parts:
            if not part.num_rows:
                continue
            block = [part.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if held is not None:
                block = [np.concatenate([a, b]) for a, b in zip(held, block)]
            # the last two rows stay: the last has no next one yet, the one before is its context
            if len(block[0]) > 2:
                yield emit(block, first, False)
                first = False
                held = [x[-2:] for x in block]
            else:
                held = block
        if held is not None:
            yield emit(held, first, True)

    found = common.stored(
        rows.select(*[F.col(c) for c in ("number", "node", "coarse", "fine")]).repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(run, "number long, node long, coarse long, fine long, shared boolean, settled boolean, open boolean, edge boolean"),
        name,
    )
    same = Window.partitionBy("coarse")
    edges = (
        found.filter("edge").withColumn("shared", F.col("shared") | (F.count("*").over(same) > 1))
        .withColumn("settled", F.col("settled") | (F.count("*").over(Window.partitionBy("coarse", "fine")) > 1))
    )
    columns = ("number", "node", "settled", "open")
    return found.filter("not edge").select(*columns).unionByName(edges.filter("shared").select(*columns))


def narrower(texts: DataFrame, width: int, before: int, length: int = LENGTH) -> DataFrame:
    """Cut nodes into ranges of `width` windows and identify each by the bytes all its windows share, refined by the bytes around them.

    `texts` has number, z (compressed text) and open, the nodes of `before` windows.
    """
    schema = pa.schema([("number", pa.int64()), ("node", pa.int64()), ("coarse", pa.int64()), ("fine", pa.int64())])

    def run(parts):
        unpack = zstandard.ZstdDecompressor()

        def rows(part):
            for number, z, nodes in zip(*(column.to_pylist() for column in part.columns)):
                data = unpack.decompress(z)
                for node in nodes:
                    at, least, most, start = unpack_node(node)
                    least_here, most_here = max(least, start), min(most, start + before - 1)
                    for low in range(start + (least_here - start) // width * width, most_here + 1, width):
                        high = low + width - 1
                        # a window that names the position lies inside the text, so the shared bytes do
                        a, b = at - low, at - high + length
                        core = data[a:b]
                        if width == 1:
                            fine = _hash(core, 1)
                        else:
                            left, right = data[max(0, at - high) : a], data[b : at - low + length]
                            fine = _hash(left + right, len(left) << 10 | len(right))
                        yield number, pack_node(at, least, most, low), _signed(_hash(core, low << 10 | width)), _signed(fine)

        for part in parts:
            yield from common.batches(rows(part), schema)

    return texts.select("number", "z", "open").mapInArrow(run, "number long, node long, coarse long, fine long")


def spans(size: int, nodes, width: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Bytes that the windows of settled nodes cover."""
    found = []
    for node in nodes:
        at, _, _, low = unpack_node(node)
        found.append((at - min(low + width - 1, at), at - max(low, at + length - size) + length))
    return found


def merged(found) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that spans cover."""
    runs: list[list[int]] = []
    for a, b in sorted(found):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [tuple(r) for r in runs]


def removed_spans(docs: DataFrame, length: int = LENGTH, q: int = GRAM, widths: tuple[int, ...] = WIDTHS) -> tuple[DataFrame, DataFrame]:
    """(scan, found): every document's scan row, and key, compressed text and settled nodes of those that may lose bytes.

    What reads the second turns nodes into runs in the same task as its own work,
    so that no task needs two Python workers.
    """
    reach = length - q
    if not 8 <= q <= length or reach > 255:
        raise ValueError("q must be at least 8 and leave at most 255 offsets; choose a longer q")
    if widths[-1] != 1 or any(a % b for a, b in zip(widths, widths[1:])):
        raise ValueError("each width must divide the one before, and the last must be 1")
    base = common.stored(scan(docs, length, q), "repeats-scan")
    each = base.select("number", F.explode(F.arrays_zip("nodes", "coarse", "fine")).alias("x")).select("number", "x.nodes", "x.coarse", "x.fine")
    first = settle(each.withColumnRenamed("nodes", "node"), "repeats-0")
    lists = first.groupBy("number").agg(
        F.collect_list(F.when(F.col("settled"), F.col("node"))).alias("whole"), F.collect_list(F.when(F.col("open"), F.col("node"))).alias("open")
    )
    # rows equal in id and text share one entry: their positions are the same
    owners = base.select("number", common.DOC, common.MARK).join(lists, "number").groupBy(common.DOC, common.MARK).agg(
        F.min(F.struct("number", "whole")).alias("x"), F.array_distinct(F.flatten(F.collect_list("open"))).alias("open")
    ).select(F.col(common.DOC).alias("d"), F.col(common.MARK).alias("m"), "x.*", "open")
    packed = _packed(docs)
    texts = common.stored(
        packed.join(owners, packed[common.DOC].eqNullSafe(owners["d"]) & (packed[common.MARK] == owners["m"]))
        .drop("d", "m").dropDuplicates([common.DOC, common.MARK]),
        "repeats-texts",
    )
    todo, before, settled = texts.filter(F.size("open") > 0).select("number", "z", "open"), reach + 1, []
    for k, width in enumerate(widths):
        level = settle(narrower(todo, width, before, length), f"repeats-{k + 1}")
        settled.append(level.filter("settled").select("number", F.struct(F.lit(width).alias("width"), "node").alias("x")))
        if width > 1:
            lists = level.filter("open").groupBy("number").agg(F.collect_list("node").alias("open"))
            todo, before = texts.select("number", "z").join(lists, "number"), width
    late = settled[0]
    for more in settled[1:]:
        late = late.unionByName(more)
    late = late.groupBy("number").agg(F.collect_list("x").alias("parts"))
    return base, texts.join(late, "number", "left").select(common.DOC, common.MARK, "z", "whole", "parts")


def _texts_and_runs(part, length: int, reach: int):
    """Id, mark, bytes and removed runs of each row of a batch of `removed_spans`."""
    unpack = zstandard.ZstdDecompressor()
    for doc, mark, z, whole, pieces in zip(*(column.to_pylist() for column in part.columns)):
        data = unpack.decompress(z)
        found = spans(len(data), whole, reach + 1, length)
        for x in pieces or ():
            found += spans(len(data), [x["node"]], x["width"], length)
        yield doc, mark, data, merged(found)


def _packed(docs: DataFrame) -> DataFrame:
    """Key and compressed text: a third of the bytes to move."""
    schema = pa.schema([("__doc", pa.int64()), ("__mark", pa.int64()), ("z", pa.binary())])

    def run(parts):
        pack = zstandard.ZstdCompressor(level=3)
        for part in parts:
            z = [pack.compress(t.encode()) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(z, type=pa.binary())], schema=schema)

    return common.texts(docs).mapInArrow(run, "__doc long, __mark long, z binary")


def kept_bytes(data: bytes, runs) -> bytes:
    at, kept = 0, []
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def digests(docs: DataFrame, length: int = LENGTH, q: int = GRAM, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of `docs`.

    Null and empty texts have no bytes and lose none, texts under `length` bytes
    lose none. Rows that repeat a text are each other's copies and lose all of it
    if it is long enough. An empty table gives no row.
    """
    base, found = removed_spans(docs, length, q, widths)
    schema = pa.schema([("__doc", pa.int64()), ("__mark", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string())])

    def run(parts):
        def rows(part):
            for doc, mark, data, runs in _texts_and_runs(part, length, length - q):
                yield doc, mark, sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept_bytes(data, runs)).hexdigest()

        for part in parts:
            yield from common.batches(rows(part), schema)

    lost = found.mapInArrow(run, "__doc long, __mark long, n_removed long, n_spans long, kept string")
    every = base.select(common.DOC, common.MARK, "n_bytes", "sha256")
    none = F.lit(0).cast("long")
    return every.join(lost, common.same_document(every, lost), "left").select(
        every[common.DOC].alias("doc_id"), "n_bytes", F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept", "sha256").alias("kept_sha256"),
    )


def dedup(docs: DataFrame, length: int = LENGTH, q: int = GRAM, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Id, kept bytes and removed spans of documents that lose bytes. Cuts may fall inside a character, so the rest is binary."""
    _, found = removed_spans(docs, length, q, widths)
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.list_(pa.int64())))])

    def run(parts):
        def rows(part):
            for doc, _, data, runs in _texts_and_runs(part, length, length - q):
                if runs:
                    yield doc, kept_bytes(data, runs), runs

        for part in parts:
            yield from common.batches(rows(part), schema, 500)

    return found.mapInArrow(run, "doc_id long, kept binary, spans array<array<long>>")
