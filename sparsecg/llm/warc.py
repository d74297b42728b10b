"""WARC derivatives: response records to linked metadata and conversion records.

A response record holds the fetched page with its HTTP header. Two records derive from it: `conversion`, the plain
text with its own type and digests, and `metadata`, fields about the page (title, language, links, sizes, and every
header of the source, WARC and HTTP). Both carry WARC-Refers-To with the response's id, its target URI and date, and
the digest of its payload. Ids are name-based, so a rerun gives the same records; digests are SHA-1 in base 32 over
the block (and for responses over the payload). A page is one row and each record of it is made from that row alone:
no shuffle, no state. parse() reads records of any WARC version back.

A payload is freed of chunks and of gzip or deflate as its HTTP header says, and read in the character set that the
header names, else a byte order mark, else the page's own meta element, else UTF-8; unknown names count as UTF-8, and
Latin-1 and ASCII as windows-1252, as in browsers. A payload in another encoding (the field contentEncoding says
which), or of a type that isn't text, has a metadata record but no conversion.

Defined results: null html is an empty payload, null url an empty target; rows repeat their records; an empty table
gives no records; page_id may be null (then ids come from url and payload alone); other columns are ignored. Bytes
that are no record (no version line, no length, a block cut short) come back as one row of record_type `malformed`
up to the next version line, and the records after them are read. Records without an id or a target get neither.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices
from .html_blocks import attributes, read

VERSION = "WARC/1.1"
#: Date of records whose table has none.
DATE = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:sparsecg:records")
#: Headers of a response that its derivatives repeat as their own; the metadata record has all of them as fields.
KEPT = ("WARC-Target-URI", "WARC-Date")
SCHEMA = "page_id long, record_type string, record_id string, refers_to string, target_uri string, block_digest string, payload_digest string, content_length long, record binary"
_TYPES = (pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary())
_LINE_ENDS = re.compile(r"[\r\n]+")

Headers = list[tuple[str, str]]


def header(headers: Headers, name: str) -> str | None:
    """The first value of a header; names have no case."""
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def _base32(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def digest(raw: bytes) -> str:
    return _base32(hashlib.sha1(raw).digest())


def record(headers: Headers, block: bytes) -> bytes:
    """One record: version, header lines, an empty line, the block and two line ends."""
    head = "".join(f"{k}: {_LINE_ENDS.sub(' ', v)}\r\n" for k, v in headers)
    return f"{VERSION}\r\n{head}\r\n".encode("utf-8", "replace") + block + b"\r\n\r\n"


@dataclass
class Record:
    """A record that was read, or bytes that are none: then error says why, and block holds them."""

    version: str
    headers: Headers
    block: bytes
    error: str = ""


_HEAD_END = re.compile(rb"\r?\n\r?\n")
_VERSION_LINE = re.compile(rb"(?:\A|(?<=\n))WARC/\d+\.\d+[ \t]*\r?\n")


def _header_lines(raw: bytes) -> Headers:
    """Names and values of header lines, with folded lines made one."""
    lines: list[str] = []
    for line in raw.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        if line[:1] in (" ", "\t") and lines:
            lines[-1] += " " + line.strip()
        elif line.strip():
            lines.append(line)
    return [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]


def parse(raw: bytes) -> Iterator[Record]:
    """The records in raw, one after another, and what stands between them if it is none."""
    at, n = 0, len(raw)
    while at < n:
        first = _VERSION_LINE.match(raw, at)
        end = _HEAD_END.search(raw, first.end() - 1) if first else None
        error = "no version line" if not first else "no end of the header" if not end else ""
        if not error:
            headers = _header_lines(raw[first.end() : end.start()])
            size = header(headers, "Content-Length") or ""
            begin = end.end()
            if not (size.isascii() and size.isdigit()):
                error = "no length"
            elif begin + int(size) > n:
                error = "a block cut short"
            else:
                at = begin + int(size)
                yield Record(raw[first.start() : first.end()].decode().strip(), headers, raw[begin:at])
                while at < n and raw[at : at + 1] in (b"\r", b"\n"):
                    at += 1
                continue
        later = _VERSION_LINE.search(raw, first.end() if first else at)
        to = later.start() if later else n
        yield Record("", [], raw[at:to], error)
        at = to


def _id(kind: str, *names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join((kind, *names)))}>"


def response(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> tuple[Headers, bytes]:
    payload = (html or "").encode("utf-8", "replace")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    sha1 = hashlib.sha1(payload)
    name = _id("response", str(page_id), url or "", sha1.hexdigest())
    return [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", name),
        ("WARC-Target-URI", url or ""),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", _base32(sha1.digest())),
        ("WARC-Block-Digest", digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ], block


def _unchunked(raw: bytes) -> bytes:
    """The body of a chunked message; what doesn't follow that form stays as it is."""
    out, at = [], 0
    while m := re.compile(rb"([0-9a-fA-F]{1,8})[^\r\n]*\r?\n").match(raw, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        out.append(raw[m.end() : m.end() + size])
        at = m.end() + size
        at += 2 if raw[at : at + 2] == b"\r\n" else 1
    return b"".join(out) if out and at >= len(raw) else raw


def body(http: Headers, payload: bytes) -> tuple[bytes, str]:
    """The payload without transfer and content encoding, and the encoding that could not be taken off."""
    if "chunked" in (header(http, "Transfer-Encoding") or "").lower():
        payload = _unchunked(payload)
    for name in reversed((header(http, "Content-Encoding") or "").lower().split(",")):
        name = name.strip()
        if name in ("", "identity"):
            continue
        try:
            if name in ("gzip", "x-gzip"):
                payload = zlib.decompress(payload, 31)
            elif name == "deflate":
                payload = zlib.decompress(payload, 15 if payload[:1] == b"\x78" else -15)
            else:
                return payload, name
        except zlib.error:
            if payload[:2] == b"\x1f\x8b" or name == "deflate":
                return payload, name  # broken; a plain body under a wrong header goes on
    return payload, ""


_CHARSET = re.compile(r"charset\s*+=\s*+[\"']?([A-Za-z0-9_.:-]++)", re.I)
_META = re.compile(rb"<meta\b([^>]{0,400})>", re.I)
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def charset(content_type: str, raw: bytes) -> str:
    """The name of the character set that a page is read in."""
    found = _CHARSET.search(content_type)
    name = found[1] if found else next((n for mark, n in _MARKS if raw.startswith(mark)), "")
    if not name:
        for m in _META.finditer(raw, 0, 4096):
            own = dict(attributes(m[1].decode("latin-1")))
            name = own.get("charset") or (f[1] if (f := _CHARSET.search(own.get("content", ""))) else "")
            if name:
                break
    try:
        name = codecs.lookup(name or "utf-8").name
    except LookupError:
        name = "utf-8"
    return "cp1252" if name in ("iso8859-1", "ascii") else name


def derive(headers: Headers, block: bytes) -> list[tuple[Headers, bytes]]:
    """The conversion, if its payload is text, and the metadata record of a response record."""
    cut = _HEAD_END.search(block)
    head, payload = (block[: cut.start()], block[cut.end() :]) if cut else (block, b"")
    status, _, lines = head.partition(b"\n")
    http = _header_lines(lines)
    raw, encoding = body(http, payload)
    kind = (header(http, "Content-Type") or "text/html").lower()
    is_text = not encoding and (kind.startswith("text/") or "xml" in kind or "json" in kind)
    set_name = charset(kind, raw) if is_text else ""
    try:
        page = raw.decode(set_name, "replace").removeprefix("\ufeff") if is_text else ""
    except (LookupError, ValueError):  # a codec that isn't for text
        set_name = "utf-8"
        page = raw.decode("utf-8", "replace")
    marked = is_text and ("html" in kind or "xml" in kind)
    found = read(page if marked else None)
    text = ("\n".join(b.text for b in found.blocks) if marked else page).encode("utf-8", "replace")
    payload_digest = header(headers, "WARC-Payload-Digest") or digest(payload)
    fields = [
        ("title", found.title),
        ("languageOfPage", found.lang.lower()),
        ("charset", set_name),
        ("contentEncoding", encoding),
        ("payloadLength", str(len(payload))),
        ("textLength", str(len(text))),
        ("sourcePayloadDigest", payload_digest),
        ("sourceBlockDigest", header(headers, "WARC-Block-Digest") or digest(block)),
        *[("sourceWarcHeader", f"{k}: {v}") for k, v in headers],
        ("sourceHeader", status.decode("utf-8", "replace").strip()),
        *[("sourceHeader", f"{k}: {v}") for k, v in http],
        *[("outlink", x) for x in found.links],
    ]
    about = "".join(f"{k}: {_LINE_ENDS.sub(' ', v)}\r\n" for k, v in fields).encode("utf-8", "replace")
    source = header(headers, "WARC-Record-ID") or ""
    kept = [(k, v) for k in KEPT if (v := header(headers, k)) is not None]
    out = []
    for name, own, form in (("conversion", text, "text/plain; charset=utf-8"), ("metadata", about, "application/warc-fields")):
        if name == "conversion" and not is_text:
            continue
        lines = [("WARC-Type", name), ("WARC-Record-ID", _id(name, source or payload_digest)), *([("WARC-Refers-To", source)] if source else []), *kept]
        lines += [("WARC-Refers-To-" + k.removeprefix("WARC-"), v) for k, v in kept]
        lines += [("WARC-Source-Payload-Digest", payload_digest), ("WARC-Block-Digest", digest(own)), ("Content-Type", form), ("Content-Length", str(len(own)))]
        out.append((lines, own))
    return out


def _row(page_id: int | None, headers: Headers, block: bytes) -> tuple:
    h = {k.lower(): v for k, v in reversed(headers)}
    return (page_id, h["warc-type"], h["warc-record-id"], h.get("warc-refers-to"), h.get("warc-target-uri"), h["warc-block-digest"], h.get("warc-payload-digest"), len(block), record(headers, block))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


def _records(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, urls, pages = (c.to_pylist() for c in b.columns)
            for lo, hi in slices(pages):
                rows = []
                for i in range(lo, hi):
                    source = response(ids[i], urls[i], pages[i], date)
                    rows += [_row(ids[i], *r) for r in (source, *derive(*source))]
                yield _batch(rows)

    return run


def derivatives(pages: DataFrame, date: str = DATE) -> DataFrame:
    """A row for each record of pages(page_id, url, html): the response and its two derivatives."""
    return arrow_map(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), _records(date), SCHEMA)


def _of_records(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for b in batches:
        for raw in (x.as_py() for x in b.column(0)):
            for r in parse(raw or b""):
                if r.error:
                    rows.append((None, "malformed", None, None, None, digest(r.block), None, len(r.block), r.block))
                elif (header(r.headers, "WARC-Type") or "").lower() == "response":
                    rows += [_row(None, *d) for d in derive(r.headers, r.block)]
                held += len(r.block)
                if rows and held > size:
                    yield _batch(rows)
                    rows, held = [], 0
    if rows:
        yield _batch(rows)


def derivatives_of(records: DataFrame) -> DataFrame:
    """The derivatives of all response records in records(record), whose rows hold one record or several; null holds none.

    A row is read whole by one task: records of a large file should come as rows of their own.
    """
    return arrow_map(records.select(F.col("record").cast("binary")), _of_records, SCHEMA)
