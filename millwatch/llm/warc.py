"""WARC derivatives: linked metadata and plain-text conversion records for responses."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.llm import common

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
EPOCH = "1970-01-01T00:00:00Z"
#: Elements whose content is no text, elements hidden if they have their end, and elements that end a line.
RAW = frozenset(("script", "style", "title"))
CLOSED = frozenset(("noscript", "template", "svg"))
BLOCKS = frozenset(
    "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav"
    " ol option p pre section table tbody td tfoot th thead tr ul body head html".split()
)
#: A tag with its attributes. Nothing in it is tried twice: each part takes all it can and gives nothing back.
_ATTRIBUTE = r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]*+)))?+"""
ATTRIBUTE = re.compile(_ATTRIBUTE)
TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)((?:{_ATTRIBUTE.replace('([', '(?:[')})*+)([\s/]*+)(>|\Z)")
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
SPACES = re.compile(r"[^\S\n]+")
LINES = re.compile(r"\s*\n\s*")


@dataclass
class Page:
    """What one pass over an HTML page finds.

    `parts` are pieces of text and, for tags that end a line, line feeds, each
    with its place; `hidden` are places of elements of `CLOSED` that have their
    end, `anchors` places and targets. Comments, raw elements and tags are gone.
    """

    parts: list[tuple[int, str]] = field(default_factory=list)
    preserved: list[tuple[int, int]] = field(default_factory=list)
    hidden: list[tuple[int, int, str]] = field(default_factory=list)
    anchors: list[tuple[int, str]] = field(default_factory=list)
    title: str | None = None
    base: tuple[int, str] | None = None


def attribute(attributes: str, wanted: str) -> str | None:
    """The value of an attribute, its first if it is repeated."""
    for m in ATTRIBUTE.finditer(attributes):
        if m[1].lower() == wanted:
            return html.unescape(next((v for v in m.groups()[1:] if v is not None), "")).strip()
    return None


def comment_end(page: str, at: int) -> int:
    """Where the comment that opens at `at` ends, or the page if it does not."""
    if page.startswith((">", "->"), at + 4):
        return page.index(">", at + 4) + 1
    m = COMMENT_END.search(page, at + 4)
    return m.end() if m else len(page)


COMMENT_END = re.compile(r"--!?>")


def scanned(page: str) -> Page:
    """One pass from tag to tag, as browsers read them: `>` in quotes ends no tag, what looks like a tag in a comment is none.

    A raw element without its end runs to the end of the page; in an svg it is
    an element like others, which the svg ends. A tag without its end is none,
    and nothing follows it.
    """
    found, at, n = Page(), 0, len(page)
    opened: dict[str, list[int]] = {name: [] for name in (*CLOSED, *RAW)}
    preserving: list[int] = []
    while at < n:
        start = page.find("<", at)
        if start < 0:
            found.parts.append((at, page[at:]))
            break
        if start > at:
            found.parts.append((at, page[at:start]))
        m = TAG.match(page, start)
        if m is None:
            following = page[start + 1 : start + 2]
            if page.startswith("<!--", start):
                at = comment_end(page, start)
                found.parts.append((start, " "))
            elif following in ("!", "?", "/") and following:
                at = page.find(">", start) + 1 or n
            else:
                found.parts.append((start, "<"))
                at = start + 1
            continue
        closing, name, attributes, slash, end = m.groups()
        at, name = m.end(), name.lower()
        if not end:
            break
        if name in BLOCKS:
            found.parts.append((start, "\n"))
            if name == "pre":
                if not closing:
                    preserving.append(at)
                elif preserving:
                    found.preserved.append((preserving[0], start))
                    preserving = []
        in_svg = bool(opened["svg"])
        if closing:
            if opened.get(name):
                begun = opened[name].pop()
                for starts in opened.values():
                    while starts and starts[-1] > begun:
                        starts.pop()
                found.hidden.append((begun, at, name))
        elif name in CLOSED:
            if not ("/" in slash and (in_svg or name == "svg")):
                opened[name].append(start)
        elif name in RAW and in_svg:
            if "/" not in slash:
                opened[name].append(start)
        elif name in RAW:
            close = ENDS[name].search(page, at)
            if name == "title" and found.title is None and close:
                found.title = page[at : close.start()]
            found.parts.append((start, " "))
            m = TAG.match(page, close.start()) if close else None
            at = m.end() if m else n
        elif name in ("a", "area"):
            if (link := attribute(attributes, "href")) is not None:
                found.anchors.append((start, link))
        elif name == "base" and found.base is None and (link := attribute(attributes, "href")) is not None:
            found.base = (start, link)
    return found


def outside(places, hidden) -> Iterator[tuple]:
    """Of (place, ...) in order those that no (start, end, ...) holds."""
    spans, k = joined((a, b) for a, b, *_ in hidden), 0
    for x in places:
        while k < len(spans) and spans[k][1] <= x[0]:
            k += 1
        if k == len(spans) or x[0] < spans[k][0]:
            yield x


def joined(spans) -> list[tuple[int, int]]:
    """The outermost of nested spans, in order."""
    found: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if not found or a >= found[-1][1]:
            found.append((a, b))
    return found


def shown_text(found: Page) -> str:
    """Readable text, one line per block; text in pre keeps its spaces and lines."""
    lines, held, kept, k = [], [], [], 0

    def flush():
        if held:
            lines.append(LINES.sub("\n", SPACES.sub(" ", html.unescape("".join(held)))).strip())
            held.clear()
        if kept:
            lines.append(html.unescape("".join(kept)).strip("\r\n"))
            kept.clear()

    spans = joined((a, b) for a, b, _ in found.hidden)
    visible = sorted([*outside(found.parts, found.hidden), *((a, " ") for a, _ in spans)], key=lambda x: x[0])
    for place, text in visible:
        while k < len(found.preserved) and found.preserved[k][1] <= place:
            k += 1
        if k < len(found.preserved) and found.preserved[k][0] <= place:
            if held:
                flush()
            kept.append(text)
        else:
            if kept:
                flush()
            held.append(text)
    flush()
    return "\n".join(x for x in lines if x.strip()).strip("\n")


def plain_text(page: str) -> str:
    """Readable text of an HTML page; hidden elements, comments and tags go, entities are decoded."""
    return shown_text(scanned(page.replace("\r\n", "\n")))


def title(page: str) -> str:
    return title_of(scanned(page))


def title_of(found: Page) -> str:
    return " ".join(html.unescape(found.title or "").split())


def links(page: str, target: str) -> list[str]:
    return links_of(scanned(page), target)


def links_of(found: Page, target: str) -> list[str]:
    """Absolute targets of anchors and areas, those of noscript content too, in order, each once; a base element shifts them."""
    def absolute(base, link):
        try:
            return urljoin(base, link)
        except ValueError:  # an address that is none is kept as it stands
            return link

    unseen = [x for x in found.hidden if x[2] != "noscript"]
    base = absolute(target, found.base[1]) if found.base and list(outside([found.base], unseen)) else target
    return list(dict.fromkeys(absolute(base, link) for _, link in outside(found.anchors, unseen)))


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def one_line(value: str) -> str:
    return " ".join(value.split())


def serialise(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A WARC/1.1 record; fields without a value are left out."""
    head = "".join(f"{name}: {one_line(value)}\r\n" for name, value in fields if value)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def responses(pages: DataFrame, date: str = EPOCH) -> DataFrame:
    """Response records of crawled pages: page_id, record_id, target_uri, date, http_headers, payload.

    Ids follow from page id, address and content, so equal rows have equal ids.
    Null addresses and contents become empty.
    """
    payload, target = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    key = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("page_id").cast("string"), F.lit("")), target, F.sha2(payload, 256)))
    ident = F.concat(F.lit("urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(key, a, n), F.lit("-"))][:-1])
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), ident.alias("record_id"), target.alias("target_uri"), F.lit(date).alias("date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n")).alias("http_headers"),
        payload.alias("payload"),
    )


SCHEMA = (
    "page_id long, warc_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, "
    "content_type string, content_length long, block_digest string, source_block_digest string, source_payload_digest string, "
    "source_headers string, block string, record binary"
)
ARROW = pa.schema([(f.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]]) for f in SCHEMA.split(", ")])


def _records(page_id, ident, target, date, headers, payload):
    """The metadata and the conversion record of one response."""
    body = payload.encode()
    source = headers.encode() + b"\r\n" + body
    payload_digest, block_digest = digest(body), digest(source)
    ids = {kind: f"urn:uuid:{uuid.uuid5(NAMESPACE, f'{ident}/{kind}')}" for kind in ("metadata", "conversion")}
    page = scanned(payload.replace("\r\n", "\n"))
    found = links_of(page, target)
    status, _, rest = headers.partition("\r\n")
    about = [("title", title_of(page)), ("http-status", status)]
    about += [("http-header", line) for line in rest.split("\r\n") if line]
    about += [("source-block-digest", block_digest), ("source-payload-digest", payload_digest), ("outlinks", str(len(found)))]
    about += [("outlink", link) for link in found]
    blocks = {
        "metadata": ("application/warc-fields", "".join(f"{k}: {one_line(v)}\r\n" for k, v in about)),
        "conversion": ("text/plain; charset=utf-8", shown_text(page)),
    }
    for kind, other in (("metadata", "conversion"), ("conversion", "metadata")):
        content_type, text = blocks[kind]
        block = text.encode()
        fields = [
            ("WARC-Type", kind), ("WARC-Record-ID", f"<{ids[kind]}>"), ("WARC-Date", date), ("WARC-Target-URI", target),
            ("WARC-Refers-To", f"<{ident}>"), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date),
            ("WARC-Concurrent-To", f"<{ids[other]}>"), ("WARC-Source-Block-Digest", block_digest),
            ("WARC-Source-Payload-Digest", payload_digest), ("WARC-Block-Digest", digest(block)),
            ("Content-Type", content_type), ("Content-Length", str(len(block))),
        ]
        yield (
            page_id, kind, ids[kind], ident, ids[other], target, date, content_type, len(block), digest(block),
            block_digest, payload_digest, headers, text, serialise(fields, block),
        )


def derive(records: DataFrame) -> DataFrame:
    """Two rows per response: its metadata and its plain-text conversion, linked to it and to each other.

    Takes the columns of `responses`; nulls in them count as empty. Every row
    gives its two records, repeated rows too, and an empty page an empty
    conversion. `record` is the record as it stands in a file, `block` its content.
    """

    def run(parts):
        for part in parts:
            rows = zip(*(column.to_pylist() for column in part.columns))
            yield from common.batches((r for row in rows for r in _records(*row)), ARROW, 2000)

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("record_id", "target_uri", "date", "http_headers", "payload")]
    return records.select(F.col("page_id").cast("long"), *text).mapInArrow(run, SCHEMA)


def segments(records: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """Files of records: partition, segment, n_records, content. Each record is a gzip member of its own, so members can be read singly."""
    schema = pa.schema([("partition", pa.int32()), ("segment", pa.int32()), ("n_records", pa.int64()), ("content", pa.binary())])

    def run(parts):
        from pyspark import TaskContext

        me, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for part in parts:
            for raw in part.column(0).to_pylist():
                member = gzip.compress(raw, mtime=0)
                if held and size + len(member) > most_bytes:
                    yield from common.batches([(me, number, len(held), b"".join(held))], schema)
                    number, held, size = number + 1, [], 0
                held.append(member)
                size += len(member)
        if held:
            yield from common.batches([(me, number, len(held), b"".join(held))], schema)

    return records.select("record").mapInArrow(run, "partition int, segment int, n_records long, content binary")
