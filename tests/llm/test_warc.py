import gzip
import time
from html.parser import HTMLParser

import pytest

from millwatch.llm import warc
from millwatch.llm.common import table

PAGES = "page_id long, url string, html string, record string, payload string, date string"


class Reader(HTMLParser):
    """Visible text by a parser, to hold the patterns against."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript", "template", "svg", "title")
        if tag in warc.BLOCKS:
            self.found.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript", "template", "svg", "title")
        if tag in warc.BLOCKS:
            self.found.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.found.append(data)


def squeezed(text):
    return "".join(text.split())


def parsed(page):
    reader = Reader()
    reader.feed(page)
    reader.close()
    return "".join(reader.found)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], PAGES)


def read_record(raw):
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = [line.split(": ", 1) for line in lines]
    return version, dict(fields), rest


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("<p>a&amp;b</p><p>c&#233;&nbsp;d", "a&b\ncé d"), ("<script>if (a<b) x()</script>y<style>p{}</style>", "y"), ("a<!-- b --><b>c</b>d", "a cd"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("<title>T</title><h1>H</h1>x<br/>y", "H\nx\ny"), ("<script>open", ""), ("a<b", "a"),
])
def test_plain_text(page, text):
    assert warc.plain_text(page) == text


@pytest.mark.parametrize(("page", "text"), [
    ("<p>a</p><svg-icon n=1></svg-icon><p>rest</p>", "a\nrest"), ("<title-bar>a</title-bar><title>T</title>b", "a b"), ("<template-x>a<p>b", "a\nb"), ("a<svg/>b<svg><p>c</svg>d", "ab d"),
    ("a<noscript>b", "ab"), ("a<template>b<svg>c", "abc"), ("a<noscript>b</noscript>c", "a c"), ("a<svg>b<svg>c</svg>d</svg>e", "a e"), ("a<svg><title/><path/></svg>b", "a b"),
    ("a<svg><title>b</svg>c", "a c"), ("<svg><template></svg>a</template>", "a"), ("<script>'</svg>'</script>a</svg>b", "ab"), ("<SVG>a</Svg >b<style>c", "b"), ("a<!-->b<!--c-->d", "a b d"),
    ("a<script>b</script x>c", "a c"), ("a<svg", "a"), ("", ""),
])
def test_only_closed_elements_hide_what_follows(page, text):
    assert warc.plain_text(page) == text


def test_links_and_title_past_elements_without_an_end():
    page = '<title-bar>x</title-bar><title>T</title><svg-icon></svg-icon><a href="/1">1</a><svg/><a href="/2">2</a><noscript><a href="/3">3</a></noscript><template><a href="/4">4</a></template><noscript><a href="/5">5'
    assert warc.links(page, "http://a.example/") == [f"http://a.example/{i}" for i in (1, 2, 3, 5)] and warc.title(page) == "T"


def test_many_open_elements_take_linear_time():
    assert warc.plain_text("<svg><title><template>" * 100_000 + "x") == "x"


def test_text_of_given_pages_is_what_a_parser_reads(spark):
    for r in table(spark, "/root/testdata/sf0.01", "pages").collect():
        assert squeezed(warc.plain_text(r["html"])) == squeezed(parsed(r["html"]))


def test_records_are_whole_and_linked(spark):
    rows = [(1, "http://a.example/x", '<title>T &amp; t</title><a href="/y">y</a><a href=\'z?q=1\'>z</a><a href="/y">y</a>'), (2, None, None), (None, "u", "<p>ü"), (1, "http://a.example/x", "other")]
    pages = warc.responses(frame(spark, rows)).collect()
    found = warc.derive(warc.responses(frame(spark, rows))).collect()
    assert len(found) == 2 * len(rows)
    by_id = {r["record_id"]: r for r in pages}
    assert len(by_id) == len(rows)
    for r in found:
        source = by_id[r["refers_to"]]
        version, fields, rest = read_record(bytes(r["record"]))
        block = rest[: int(fields["Content-Length"])]
        assert version == "WARC/1.1" and rest[len(block) :] == b"\r\n\r\n" and block.decode() == r["block"]
        assert fields["WARC-Record-ID"] == f"<{r['record_id']}>" and fields["WARC-Refers-To"] == f"<{source['record_id']}>"
        assert fields["WARC-Block-Digest"] == r["block_digest"] == warc.digest(block) and r["content_length"] == len(block)
        assert fields["WARC-Source-Payload-Digest"] == r["source_payload_digest"] == warc.digest(source["payload"].encode())
        assert r["source_headers"] == source["http_headers"]
        other = next(o for o in found if o["record_id"] == r["concurrent_to"])
        assert other["concurrent_to"] == r["record_id"] and other["warc_type"] != r["warc_type"]
    about = next(r["block"] for r in found if r["warc_type"] == "metadata" and "T & t" in r["block"]).split("\r\n")
    assert [x for x in about if x.startswith("outlink:")] == ["outlink: http://a.example/y", "outlink: http://a.example/z?q=1"]
    assert "http-header: Content-Type: text/html; charset=utf-8" in about and "outlinks: 2" in about


def test_repeated_and_empty_pages(spark):
    same = (5, "http://b.example/", "<p>x</p>")
    found = warc.derive(warc.responses(frame(spark, [same, same]))).collect()
    assert len(found) == 4 and len({r["record_id"] for r in found}) == 2
    assert warc.derive(warc.responses(frame(spark, []))).collect() == []
    nothing = spark.createDataFrame([(None,) * 6], "page_id long, record_id string, target_uri string, date string, http_headers string, payload string")
    assert {r["warc_type"]: r["content_length"] > 0 for r in warc.derive(nothing).collect()} == {"metadata": True, "conversion": False}


def test_segments_hold_single_members(spark):
    records = warc.derive(warc.responses(frame(spark, [(i, f"http://c.example/{i}", f"<p>{i}") for i in range(20)]))).coalesce(1)
    files = warc.segments(records, most_bytes=2000).collect()
    assert len(files) > 1 and sum(f["n_records"] for f in files) == 40
    whole = b"".join(gzip.decompress(bytes(f["content"])) for f in sorted(files, key=lambda f: f["segment"]))
    assert whole == b"".join(bytes(r["record"]) for r in records.collect())


HERE = "http://b.example/dir/p"


@pytest.mark.parametrize(
    ("page", "text", "title", "links"),
    [
        ('<a title="x > y">z</a>', "z", "", []),
        ('<a title="x > y" href="q">z</a>', "z", "", ["http://b.example/dir/q"]),
        ("<a title='it > is' HREF=q>z</a>", "z", "", ["http://b.example/dir/q"]),
        ('<a data-href="/wrong" href="/right">z', "z", "", ["http://b.example/right"]),
        ('<a href="/first" href="/second">z', "z", "", ["http://b.example/first"]),
        ('<base href="http://c.example/e/"><a href=p>z', "z", "", ["http://c.example/e/p"]),
        ('<base href="/up/"><base href="/no/"><a href=p>z', "z", "", ["http://b.example/up/p"]),
        ('<!-- <base href="/no/"> --><a href=p>z', "z", "", ["http://b.example/dir/p"]),
        ("<svg><title>icon</title></svg><title>Page</title>t", "t", "Page", []),
        ("<!-- <title>old</title> --><title>Page &amp; more</title>t", "t", "Page & more", []),
        ("<script>'<title>no</title>'</script><title>Page</title>t", "t", "Page", []),
        ("<map><area href=k><area shape=rect></map>", "", "", ["http://b.example/dir/k"]),
        ("a<pre>  x\n    y </pre>b", "a\n  x\n    y \nb", "", []),
        ("a<pre>\n<b>x</b>  &lt;y&gt;\n\n z\n</pre>", "a\nx  <y>\n\n z", "", []),
        ("5 < 6 <b>c</b> </ d> e <> f", "5 < 6 c e <> f", "", []),
        ("a<!-->b<!--->c<!-- d --!>e<!-- f", "a b c e", "", []),
        ("<a href=x/>y</a><p a", "y", "", ["http://b.example/dir/x/"]),
        ("<noscript><a href=n>x</a></noscript><template><a href=t>x</a></template>y", "y", "", ["http://b.example/dir/n"]),
        ("<p title=a'b>c</p><p title = \"d>e\" >f</p>", "c\nf", "", []),
    ],
)
def test_pages_are_read_as_browsers_do(page, text, title, links):
    assert (warc.plain_text(page), warc.title(page), warc.links(page, HERE)) == (text, title, links)


BROKEN = ("<a ", "<title>", "<!--", "<a href='", "<a" + " " * 50, "<pre>", "<noscript>", "</", '<p a="', "<svg><title>", "<style>", "<a b=", "&", "<", "<script></scrip>")


@pytest.mark.parametrize("piece", BROKEN)
def test_broken_pages_take_linear_time(piece):
    """A megabyte of any opening without its end."""
    page = piece * (1_000_000 // len(piece))
    start = time.perf_counter()
    for around in (page, f"<svg>{page}</svg>", f"{page}</title></a>"):
        warc.plain_text(around), warc.title(around), warc.links(around, HERE)
    assert time.perf_counter() - start < 30
