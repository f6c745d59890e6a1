import hashlib
import re
import time

from clickloom.llm import warc


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h in rows], "page_id bigint, url string, html string, record_type string, block int")


def test_plain_text():
    page = "<html lang=EN><head><title>A &amp; B</title><script>x<p>y</script></head><!-- <p>no --><body><p>One &lt;b&gt; <b>t</b>wo<br>x&#233;&eacute;</p><style>p{}</style> end<scr"
    assert warc.plain_text(page) == "One <b> two\nxéé\nend"
    assert warc.plain_text("") == "" and warc.plain_text("a<script>never closed") == "a"
    assert "title: A & B\r\nlanguage: en\r\n" in warc.warc_fields(page, "HTTP/1.1 404 Gone\r\n", "d", "t")
    assert "http-status: 404\r\n" in warc.warc_fields(page, "HTTP/1.1 404 Gone\r\n", "d", "t")
    links = warc.warc_fields("<a href='x?a&amp;b'>1</a><A class=c HREF=/y>2</a><a name=z>", "", "", "")
    assert links.split("\r\n")[-3:-1] == ["outlink: x?a&b", "outlink: /y"]


def test_records_are_linked_and_digested(spark):
    rows = [(1, "http://a/", "<p>é"), (2, None, None), (3, "http://c/", ""), (1, "http://a/", "<p>é")]
    source = {(r.page_id, r.record_id): r for r in warc.responses(pages(spark, rows)).collect()}
    got = warc.serialise(warc.derivatives(warc.responses(pages(spark, rows)))).collect()
    assert len(got) == 8 and len({r.record_id for r in got}) == 6
    for r in got:
        origin = source[r.page_id, r.refers_to]
        assert (r.target_uri, r.warc_date, r.source_header, r.source_payload_digest) == (origin.target_uri, origin.warc_date, origin.http_header, origin.payload_digest)
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.content_length == len(r.block.encode())
        head, _, body = r.record.partition("\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
        assert fields["WARC-Refers-To"] == r.refers_to and fields["WARC-Type"] == r.record_type and body == r.block + "\r\n\r\n"
        assert int(fields["Content-Length"]) == len(r.block.encode())
    assert {r.block for r in got if r.record_type == "conversion" and r.page_id == 1} == {"é"}


def test_empty_table(spark):
    assert warc.derivatives(warc.responses(pages(spark, []))).count() == 0


def test_hostile_pages_take_linear_time():
    for unit in ("<a ", "<html ", "<script ", "<title ", "<a href ", "<a href=\"", "<a href='", "<!--", "<!-- -->", "<script>", "</script ", "lang=", "<a b href=", "<", "&amp", "<title><a >"):
        page = unit * (1_000_000 // len(unit))
        began = time.perf_counter()
        warc.warc_fields(page, "", "", warc.plain_text(page))
        assert time.perf_counter() - began < 2, unit


def test_scanners_equal_plain_patterns():
    """On short texts the scanners find what the patterns that they stand for find."""
    import random

    drop = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
    link = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
    lang = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
    title = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.I | re.S)
    rng, parts = random.Random(1), ["<a", "<a ", " href=", "href", "'", '"', ">", "x", "<html ", "lang = en", "<!--", "-->", "<script", "</script >", "<TITLE>", "</title>", "\n", "<style>", "="]
    for _ in range(20_000):
        page = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert warc.without_dropped(page) == drop.sub("", page), page
        assert [m.groups() for m in warc.attributes(page, warc._ANCHOR, warc._HREF, warc._HREF_VALUE)] == [m.groups() for m in link.finditer(page)], page
        got, want = next(warc.attributes(page, warc._HTML, warc._LANG, warc._LANG_VALUE), None), lang.search(page)
        assert (got and got[1]) == (want and want[1]), page
        want = title.search(page)
        assert warc.title_of(page) == (want[1] if want else ""), page


def test_line_ends_in_values(spark):
    r = warc.serialise(warc.derivatives(warc.responses(pages(spark, [(1, "http://a/\r\nX: y", "<p>t")])))).first()
    head = r.record.partition("\r\n\r\n")[0].split("\r\n")
    assert "WARC-Target-URI: http://a/ X: y" in head and "WARC-Source-Block-Digest: " + r.source_block_digest in head
    assert any(x.startswith("WARC-Source-HTTP-Header: HTTP/1.1 200 OK Content-Type") for x in head)
