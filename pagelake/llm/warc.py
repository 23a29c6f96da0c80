"""WARC derivatives: for each response record, a linked metadata record and a plain-text conversion record.

A response record is a row (record_id, target_uri, date, block), the block being a whole HTTP message. Both derivatives
name the response in WARC-Refers-To and carry its target URI and date. The metadata record's block (application/warc-fields)
keeps the response's payload digest and length, its status and source headers (each as `source-header: name: value`) and
what the page says of itself (title, language, number of links). The conversion record's block is the payload as plain text.
Digests are SHA-1 in base 32, as is usual in such files. Record ids are version 5 UUIDs of the response's id and the kind,
so a retried task writes the same records.

`to_bytes` and `parse` write and read records in the WARC/1.1 format; `members` makes one gzip member per record, as files
of this kind hold them, and `read` takes files apart again.

Defined results: a response whose block is null, or whose payload has no text, gets an empty conversion block. A payload
that isn't text, HTML or XML by its content type gets only a metadata record. Bytes that don't decode are replaced, never
dropped. A page of any length and however malformed takes time in proportion to its length. Repeated rows give repeated
records; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import only

RESPONSES = "record_id string, target_uri string, date string, block binary"
DERIVATIVES = "record_id string, type string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, source_digest string, block binary"
_NAMES = [x.split()[0] for x in DERIVATIVES.split(", ")]
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the fixed namespace of URLs
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "template", "noscript")}
_TITLE_END = re.compile(r"</title\s*>", re.I)
_LANGUAGE = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_BREAK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
_OPEN = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*+)")
_END = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>")
_RUN = re.compile(r"[^\S\n]+")
_LINK = re.compile(r"\bhref\s*=", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '|'.join(parts))}>"


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order and payload of an HTTP message; a block without a header part is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    end = re.search(rb"\r?\n\r?\n", block)
    head, payload = (block[: end.start()], block[end.end() :]) if end else (block, b"")
    lines = head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    headers: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in " \t" and headers:  # a folded line continues the one before
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            headers.append((name.strip(), value.strip()))
    return lines[0], headers, payload


class Page:
    """What a page says: its text in pieces with a line break at each block, title, language and number of links.

    One pass from tag to tag. A tag ends at the first > outside quotes; where quotes don't close, at the first > at all. The
    looks ahead for quotes that don't close are given up once they have cost some times the page's length, so that the
    time is in proportion to the length of any page. A tag without an end is text; an open comment or script hides the rest."""

    def __init__(self, markup: str):
        self.pieces: list[str] = []
        self.title: str | None = None
        self.language: str | None = None
        self.links = 0
        at, size, last, ahead = 0, len(markup), markup.rfind(">"), 4 * len(markup)
        while True:
            begin = markup.find("<", at)
            if begin < 0:
                break
            if markup.startswith("<!--", begin):
                self._text(markup[at:begin])
                end = markup.find("-->", begin + 4)
                if end < 0:
                    return
                at = end + 3
                self.pieces.append(" ")
                continue
            if begin > last:
                # No tag ends any more, but a comment may still begin.
                comment = markup.find("<!--", begin)
                self._text(markup[at : comment if comment >= 0 else size])
                return
            if markup[begin + 1] in "!?":
                self._text(markup[at:begin] + " ")
                at = markup.find(">", begin) + 1
                continue
            tag = _OPEN.match(markup, begin)
            if tag is None:
                self._text(markup[at : begin + 1])
                at = begin + 1
                continue
            self._text(markup[at:begin])
            end = _END.match(markup, tag.end()) if ahead > 0 else None
            if end is None:
                ahead -= size - begin
            at = end.end() if end is not None else markup.find(">", begin) + 1
            name, closing = tag[1].lower(), markup[begin + 1] == "/"
            if name in _BREAK:
                self.pieces.append("\n")
            if closing:
                continue
            if name in _RAW:
                close = _RAW[name].search(markup, at)
                if close is None:
                    return
                at = close.end()
                self.pieces.append(" ")
            elif name == "a":
                self.links += _LINK.search(markup, tag.end(), at) is not None
            elif name == "title" and self.title is None:
                close = _TITLE_END.search(markup, at)
                self.title = " ".join(html.unescape(markup[at : close.start()]).split()) if close else ""
            elif name == "html" and self.language is None and (found := _LANGUAGE.search(markup, tag.end(), at)):
                self.language = found[1]
        self._text(markup[at:])

    def _text(self, text: str) -> None:
        if text:
            self.pieces.append(text.replace("\n", " ").replace("\r", " "))

    def text(self) -> str:
        lines = (_RUN.sub(" ", line).strip() for line in html.unescape("".join(self.pieces)).split("\n"))
        return "\n".join(line for line in lines if line)


def plain_text(markup: str) -> str:
    """Text of an HTML page: no scripts, styles or comments; a line per block; entities resolved; blank lines dropped."""
    return Page(markup).text()


def derive(row_id: str | None, uri: str | None, date: str | None, block: bytes | None) -> list[tuple]:
    """The derivatives of one response, as rows of DERIVATIVES."""
    block = block or b""
    status, headers, payload = split_http(block)
    low = {k.lower(): v for k, v in reversed(headers)}
    kind = low.get("content-type", "text/html").lower()
    charset = re.search(r"charset\s*=\s*[\"']?([^\s;\"']+)", kind)
    try:
        text = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        text = payload.decode("utf-8", "replace")
    row_id = row_id if row_id is not None else record_id("response", uri or "", date or "", digest(block))
    source = digest(payload)
    is_markup = "html" in kind or "xml" in kind
    fields = [("refers-to-payload-digest", source), ("payload-length", str(len(payload)))]
    if status:
        fields.append(("source-status", status))
    fields += [("source-header", f"{k}: {v}") for k, v in headers]
    if is_markup:
        page = Page(text)
        fields += [("title", page.title)] if page.title else []
        fields += [("language", page.language)] if page.language else []
        fields.append(("links", str(page.links)))
    metadata = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    made = [("metadata", "application/warc-fields", metadata)]
    if is_markup or kind.startswith("text/"):
        made.append(("conversion", "text/plain; charset=utf-8", (page.text() if is_markup else text).encode("utf-8", "replace")))
    return [(record_id(row_id, k), k, row_id, uri, date, content, digest(body), digest(body) if k == "conversion" else None, source, body) for k, content, body in made]


def derivatives(responses: DataFrame) -> DataFrame:
    """responses(record_id, target_uri, date, block) -> rows of DERIVATIVES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Few rows at a time, so that large pages don't pile up.
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [made for row in zip(*(part[c].to_pylist() for c in ("record_id", "target_uri", "date", "block"))) for made in derive(*row)]
                kinds = [pa.string()] * 9 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(10)], _NAMES)

    return only(responses, "record_id", "target_uri", "date", "block").mapInArrow(run, DERIVATIVES)


def responses_of(pages: DataFrame, date: str) -> DataFrame:
    """pages(page_id, url, html) as response records with the columns of RESPONSES and page_id."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    h = F.sha1(F.concat_ws("|", F.lit("response"), F.col("page_id").cast("string"), F.col("url")))
    uid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    named = only(pages, "page_id", "url", "html")
    return named.select("page_id", F.concat(F.lit("<urn:uuid:"), uid, F.lit(">")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.concat(F.encode(head, "UTF-8"), body).alias("block"))


_HEADERS = (("type", "WARC-Type"), ("record_id", "WARC-Record-ID"), ("refers_to", "WARC-Refers-To"), ("target_uri", "WARC-Target-URI"), ("date", "WARC-Date"), ("content_type", "Content-Type"), ("block_digest", "WARC-Block-Digest"), ("payload_digest", "WARC-Payload-Digest"))


def to_bytes(row: dict) -> bytes:
    """One record in the WARC/1.1 format."""
    head = ["WARC/1.1"] + [f"{name}: {' '.join(str(row[k]).split())}" for k, name in _HEADERS if row.get(k) is not None]
    block = row["block"] or b""
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a stream; a record at a time is held."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip()] = value.strip()
        n = int(headers["Content-Length"])
        block = stream.read(n)
        if len(block) < n:
            raise ValueError("a record is cut off")
        yield headers, block


def members(records: DataFrame) -> DataFrame:
    """Each record of DERIVATIVES as a gzip member: record_id, member. Members one after another are a .warc.gz file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([r["record_id"] for r in rows], pa.string()), pa.array([gzip.compress(to_bytes(r), 6, mtime=0) for r in rows], pa.binary())], ["record_id", "member"])

    return records.select(*_NAMES).mapInArrow(run, "record_id string, member binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of .warc or .warc.gz files under a path that Spark reads: file, headers, block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch["path"].to_pylist(), batch["content"]):
                raw = io.BytesIO(content.as_py())
                stream = gzip.GzipFile(fileobj=raw) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw
                for headers, block in parse(stream):
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([list(headers.items())], pa.map_(pa.string(), pa.string())), pa.array([block], pa.binary())], ["file", "headers", "block"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, headers map<string,string>, block binary")
