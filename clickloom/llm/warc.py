"""WARC derivative builder.

``responses`` shapes a crawl table as WARC ``response`` records (record id,
target URI, date, HTTP header block, payload, digests).  ``derivatives`` makes
two linked records of every response:

* ``metadata`` (``application/warc-fields``): title, language, the source's
  HTTP status and content type, its digests, text size and all out-links;
* ``conversion`` (``text/plain``): the page's readable text.

Both carry ``WARC-Refers-To`` (the response's record id), the source's target
URI, date, HTTP header lines and payload digest, and a digest of their own
block.  Record ids are derived from the source's id, so a task that runs
again writes the same records.  ``serialise`` gives the bytes of a record as
they stand in a WARC file.

Defined cases: a NULL url or page counts as empty; an empty page gives an
empty conversion block; repeated rows give repeated records; an unclosed
comment, script or tag runs to the end of the page; every page is passed over in
linear time, whatever it holds; unknown entities stay as
they are; an empty table gives no rows; further columns of the input are not
carried along.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Crawl date of tables that carry none.
DEFAULT_DATE = "2024-01-01T00:00:00Z"

RESPONSE_SCHEMA = "page_id bigint, record_id string, target_uri string, warc_date string, http_header string, payload string, payload_digest string, block_digest string"
DERIVATIVE_SCHEMA = (
    "page_id bigint, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "content_length bigint, block_digest string, source_payload_digest string, source_block_digest string, source_header string, block string"
)

# The element lists are those of the HTML standard.
_OPENS = re.compile(r"<!--|<(script|style|noscript|template|title)\b", re.I)
_CLOSES = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template", "title")}
_BLOCK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|center|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|"
    r"section|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*(?:>|\Z)",
    re.I,
)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*(?:>|\Z)")
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b", re.I)
_HTML, _LANG = re.compile(r"<html\b", re.I), re.compile(r"\blang(?=\s*=)", re.I)
_ANCHOR, _HREF = re.compile(r"<a\b", re.I), re.compile(r"\bhref(?=\s*=)", re.I)
_LANG_VALUE = re.compile(r"\s*=\s*[\"']?([A-Za-z0-9-]+)")
_HREF_VALUE = re.compile(r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


class Ends:
    """Places of a text's ``>`` for growing questions: every character is passed once."""

    def __init__(self, page: str) -> None:
        self.page, self.at = page, -2

    def after(self, place: int) -> int:
        """The first ``>`` from ``place`` on, or the text's length."""
        if self.at < place:
            self.at = self.page.find(">", place)
            self.at = len(self.page) if self.at < 0 else self.at
        return self.at


def without_dropped(page: str) -> str:
    """``page`` without comments and elements that hold no readable text."""
    kept, at, ends = [], 0, Ends(page)
    while m := _OPENS.search(page, at):
        if m[1] is None:
            stop = page.find("-->", m.end())
            stop = len(page) if stop < 0 else stop + 3
        else:
            tag = ends.after(m.end())
            if tag == len(page):  # an unclosed tag opens no element; the tag rule takes it out
                kept.append(page[at : m.end()])
                at = m.end()
                continue
            close = _CLOSES[m[1].lower()].search(page, tag + 1)
            stop = close.end() if close else len(page)
        kept.append(page[at : m.start()])
        at = stop
    return "".join([*kept, page[at:]])


def attributes(page: str, tag: re.Pattern, name: re.Pattern, value: re.Pattern) -> Iterator[re.Match]:
    """Values of an attribute in the tags of one kind, in order."""
    hits = [(m.start(), v) for m in name.finditer(page) if (v := value.match(page, m.end()))]
    ends, at, k = Ends(page), 0, 0
    for m in tag.finditer(page):
        if m.start() < at:
            continue
        while k < len(hits) and hits[k][0] < m.end():
            k += 1
        if k < len(hits) and hits[k][0] <= ends.after(m.end()):
            yield hits[k][1]
            at = hits[k][1].end()


def title_of(page: str) -> str:
    m = _TITLE.search(page)
    tag = page.find(">", m.end()) if m else -1
    if tag < 0:
        return ""
    close = _CLOSES["title"].search(page, tag + 1)
    return page[tag + 1 : close.start() if close else len(page)]


def digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record_id(*parts: str) -> str:
    h = hashlib.md5("\n".join(parts).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def plain_text(page: str) -> str:
    """Readable text: dropped elements out, block tags to line ends, other
    tags out, entities decoded, blanks and empty lines folded."""
    text = _TAG.sub("", _BLOCK.sub("\n", without_dropped(page)))
    return _LINES.sub("\n", _BLANKS.sub(" ", html.unescape(text))).strip(" \n")


def warc_fields(page: str, header: str, payload_digest: str, text: str) -> str:
    """Body of the metadata record: one ``name: value`` line each."""
    lang = next(attributes(page, _HTML, _LANG, _LANG_VALUE), None)
    lines = [
        "title: " + _BLANKS.sub(" ", html.unescape(title_of(page)).replace("\n", " ")).strip(),
        "language: " + (lang[1].lower() if lang else ""),
        "http-status: " + (header.split(" ", 2)[1] if header.count(" ") else ""),
        "payload-digest: " + payload_digest,
        f"text-length: {len(text)}",
    ]
    lines += ["outlink: " + html.unescape(next(filter(None, m), "")).replace("\n", " ").replace("\r", " ") for m in (x.groups() for x in attributes(page, _ANCHOR, _HREF, _HREF_VALUE))]
    return "".join(x + "\r\n" for x in lines)


def responses(pages: DataFrame, date: str = DEFAULT_DATE) -> DataFrame:
    """``response`` records of a crawl table (page_id, url, html)."""

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for page_id, url, page in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                url, page = url or "", page or ""
                body = page.encode()
                header = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n"
                rows.append(
                    (page_id, record_id("response", str(page_id), url), url, date, header, page, digest(body), digest(header.encode() + b"\r\n" + body))
                )
            yield _batch(rows, _RESPONSE_ARROW)

    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(build, RESPONSE_SCHEMA)


def derivatives(records: DataFrame) -> DataFrame:
    """Linked ``metadata`` and ``conversion`` records of ``response`` records."""

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for r in part.to_pylist():
                page, header = r["payload"] or "", r["http_header"] or ""
                text = plain_text(page)
                for kind, mime, block in (
                    ("metadata", "application/warc-fields", warc_fields(page, header, r["payload_digest"], text)),
                    ("conversion", "text/plain; charset=utf-8", text),
                ):
                    data = block.encode()
                    rows.append(
                        (r["page_id"], kind, record_id(kind, r["record_id"]), r["record_id"], r["target_uri"], r["warc_date"], mime, len(data))
                        + (digest(data), r["payload_digest"], r["block_digest"], header, block)
                    )
            yield _batch(rows, _DERIVATIVE_ARROW)

    return records.mapInArrow(build, DERIVATIVE_SCHEMA)


def serialise(records: DataFrame) -> DataFrame:
    """Add ``record``: the derivative's bytes in a WARC file, named header
    lines first, then a blank line, the block and two line ends.  Line ends
    inside a value become one blank, so the source's HTTP header is one line."""
    flat = lambda value: F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), "[\\r\\n]+", " "))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), flat(value), F.lit("\r\n"))
    return records.withColumn(
        "record",
        F.concat(
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", F.col("record_type")),
            line("WARC-Record-ID", F.col("record_id")),
            line("WARC-Refers-To", F.col("refers_to")),
            line("WARC-Target-URI", F.col("target_uri")),
            line("WARC-Date", F.col("warc_date")),
            line("WARC-Block-Digest", F.col("block_digest")),
            line("WARC-Source-Payload-Digest", F.col("source_payload_digest")),
            line("WARC-Source-Block-Digest", F.col("source_block_digest")),
            line("WARC-Source-HTTP-Header", F.col("source_header")),
            line("Content-Type", F.col("content_type")),
            line("Content-Length", F.col("content_length").cast("string")),
            F.lit("\r\n"),
            F.col("block"),
            F.lit("\r\n\r\n"),
        ),
    )


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in schema.split(", "))])


_RESPONSE_ARROW, _DERIVATIVE_ARROW = _arrow(RESPONSE_SCHEMA), _arrow(DERIVATIVE_SCHEMA)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
