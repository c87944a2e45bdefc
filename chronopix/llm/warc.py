"""WARC derivative builder: metadata and plain-text conversion records from responses.

For every ``response`` record two linked records are built.  The ``metadata``
record (``application/warc-fields``) holds the source record's named fields, the
HTTP status and headers, the title and the out-links; the ``conversion`` record
holds the page's visible text.  Both refer to the source by ``WARC-Refers-To``,
keep its target URI and date, carry digests of their own block, and the
conversion names the source's payload digest.  Record ids are UUIDs (version 5)
of the source's id and the derivative's type, so a rerun, or a task that runs
twice after an executor was lost, builds the same bytes.

Rows are converted one by one within their task; nothing is shuffled.

Defined results: null pages become responses with an empty payload, whose
conversion is empty; records of other types give nothing; cut-off or garbled
records, bodies and encodings are read as far as they go; a source digest that
the payload does not match is kept and ``digest_ok`` is false (null without a
digest); very long payloads are read whole; repeated rows each give their
records; other columns make no difference.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopix.llm.common import map_batches
from chronopix.llm.dom import clean, parse
from chronopix.shipping import ship_package

_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-derivatives")
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)
_LINK = re.compile(r"<(a|area|img|link|script|iframe|form)\b[^>]*?\b(href|src|action)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(map(str, parts)))}>"


@dataclass
class Record:
    """A WARC record: named fields in order (names as written) and the block."""

    fields: list[tuple[str, str]]
    block: bytes = b""
    version: str = "WARC/1.1"
    complete: bool = True

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.fields if k.lower() == name.lower()), None)

    def bytes(self) -> bytes:
        one_line = lambda v: re.sub(r"[\r\n]+", " ", v)
        head = "".join(f"{k}: {one_line(v)}\r\n" for k, v in self.fields if k.lower() != "content-length")
        return f"{self.version}\r\n{head}Content-Length: {len(self.block)}\r\n\r\n".encode("utf-8", "replace") + self.block + b"\r\n\r\n"


def _fields(head: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\n"):
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def _head_end(data: bytes, at: int) -> tuple[int, int]:
    """(end of the head, start of the body)."""
    found = [(p, p + len(s)) for s in (b"\r\n\r\n", b"\n\n") if (p := data.find(s, at)) >= 0]
    return min(found, default=(len(data), len(data)))


def records(data: bytes) -> Iterator[Record]:
    """The records of an uncompressed or gzipped WARC file (one member or many), as far as it can be read."""
    if data[:2] == b"\x1f\x8b":
        for member in _members(data):
            yield from records(member)
        return
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end, body = _head_end(data, at)
        first, _, rest = data[at:end].partition(b"\n")
        fields = _fields(rest)
        n = next((int(v) for k, v in fields if k.lower() == "content-length" and v.isdigit()), 0)
        yield Record(fields, data[body : body + n], first.decode("latin-1").strip(), body + n <= len(data))
        at = max(body + n, at + 5)


def _inflate(data: bytes, bits: int) -> tuple[bytes, bytes | None, bool]:
    """(what can be decompressed; what follows the stream, None if its end was not met; no error)."""
    d = zlib.decompressobj(bits)
    try:
        out = d.decompress(data) + d.flush()
        return out, d.unused_data if d.eof else None, True
    except zlib.error:
        pass
    # again by single bytes, so that all that comes before the error is kept
    d, out = zlib.decompressobj(bits), []
    try:
        for k in range(len(data)):
            out.append(d.decompress(data[k : k + 1]))
    except zlib.error:
        pass
    return b"".join(out), None, False


_CHUNK = 1 << 16


def _members(data: bytes) -> Iterator[bytes]:
    """The gzip members; after a broken one, or bytes between two, from the next header on.

    Read in chunks, so that a member costs its own length and not that of all that follows.
    """
    view, at = memoryview(data), 0
    while (at := data.find(b"\x1f\x8b\x08", at)) >= 0:
        d, out, here = zlib.decompressobj(31), [], at
        try:
            while not d.eof and here < len(data):
                out.append(d.decompress(view[here : here + _CHUNK]))
                here += _CHUNK
            out.append(d.flush())
        except zlib.error:
            # the bad chunk again by single bytes, so that all that comes before the error is kept
            d, out = zlib.decompressobj(31), []
            if here > at:
                out.append(d.decompress(view[at:here]))
            try:
                for k in range(here, min(here + _CHUNK, len(data))):
                    out.append(d.decompress(view[k : k + 1]))
            except zlib.error:
                pass
        yield b"".join(out)
        at = min(here, len(data)) - len(d.unused_data) if d.eof and not d.unconsumed_tail else at + 3


@dataclass
class Response:
    """An HTTP response: status line, headers, decoded payload."""

    status: str
    headers: list[tuple[str, str]]
    body: bytes = b""
    payload: bytes = b""
    text: str = field(default="", repr=False)


def http_response(block: bytes) -> Response:
    end, start = _head_end(block, 0)
    first, _, rest = block[:end].partition(b"\n")
    if not first.startswith(b"HTTP/"):
        first, rest, start = b"", b"", 0
    out = Response(first.decode("latin-1").strip(), _fields(rest), block[start:])
    get = lambda name: next((v.lower() for k, v in out.headers if k.lower() == name), "")
    data = _dechunk(out.body) if "chunked" in get("transfer-encoding") else out.body
    if "gzip" in get("content-encoding") or "deflate" in get("content-encoding"):
        for bits in (47, -15):
            got, rest, whole = _inflate(data, bits)
            if not whole and (bits < 0 or not got):
                continue
            if rest and rest[:2] == b"\x1f\x8b":
                got += b"".join(_members(rest))
            data = got
            break
    out.payload = data
    kind = get("content-type")
    if not kind or "html" in kind or "text" in kind or "xml" in kind:
        m = _CHARSET.search(kind.encode()) or _CHARSET.search(data[:2048])
        try:
            out.text = data.decode(m[1].decode() if m else "utf-8", "replace")
        except LookupError:
            out.text = data.decode("utf-8", "replace")
    return out


def _dechunk(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            n = int(body[at:end].split(b";")[0].strip() or b"0", 16)
        except ValueError:
            return body if not out else b"".join(out)
        if not n:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def visible_text(source: str) -> str:
    """All visible blocks of a page, one a line."""
    texts = (clean(x.text) for x in parse(source) if x.text)
    return "\n".join(t for t in texts if t)


def derive(source: Record) -> tuple[Record, Record, bool | None] | None:
    """(metadata, conversion, whether the payload fits the source's digest) of a response; None for other records."""
    if (source.get("WARC-Type") or "").lower() != "response":
        return None
    own = source.get("WARC-Record-ID") or record_id(source.get("WARC-Target-URI"), source.get("WARC-Date"), digest(source.block))
    http = http_response(source.block)
    claimed = source.get("WARC-Payload-Digest")
    fits = None if claimed is None else claimed.split(":")[-1].upper() in (digest(http.body).split(":")[1], digest(http.payload).split(":")[1])
    payload_digest = claimed or digest(http.body)
    is_html = "<" in http.text
    text = visible_text(http.text) if is_html else "\n".join(t for t in (clean([x]) for x in http.text.split("\n")) if t)
    lines = [f"source-record-id: {own}"]
    lines += [f"source-{k.lower()}: {v}" for k, v in source.fields if k.lower() not in ("warc-record-id", "content-length")]
    lines.append(f"http-status: {http.status}")
    lines += [f"http-header: {k}: {v}" for k, v in http.headers]
    if m := _TITLE.search(http.text):
        lines.append(f"title: {clean([html.unescape(m[1])])}")
    for tag, name, a, b, c in _LINK.findall(http.text):
        lines.append(f"outlink: {clean([html.unescape(a or b or c)])} {tag.lower()}/@{name.lower()}")
    out = []
    for kind, content, block in (("metadata", "application/warc-fields", "".join(f"{x}\r\n" for x in (re.sub(r"[\r\n]+", " ", x) for x in lines)).encode("utf-8", "replace")), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace"))):
        fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(own, kind)), ("WARC-Refers-To", own)]
        fields += [(k, v) for k in ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address", "WARC-Warcinfo-ID") if (v := source.get(k)) is not None]
        fields += [("WARC-Block-Digest", digest(block)), ("Content-Type", content)]
        if kind == "conversion":
            fields.insert(3, ("WARC-Source-Payload-Digest", payload_digest))
        out.append(Record(fields, block))
    return out[0], out[1], fits


def page_response(key: object, url: str | None, source: str | None, date: str = "2024-01-01T00:00:00Z") -> Record:
    """A page as the response record of a crawl."""
    payload = (source or "").encode("utf-8", "replace")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url)), ("WARC-Target-URI", url or "urn:unknown"), ("WARC-Date", date), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
    return Record(fields, block)


def responses(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, record): every page as the bytes of a response record."""
    kind = dict(pages.dtypes)[id_column]
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    return map_batches(rows, lambda: lambda ids, urls, sources: [ids, [page_response(*x).bytes() for x in zip(ids, urls, sources, strict=True)]], ["id", "url", "html"], f"id {kind}, record binary", 128)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(id, record): the records of .warc and .warc.gz files, id being file name and place.

    One file is one task's row, as the format has no split points; files of the
    usual gigabyte are meant, and Spark's reader takes none over 2 GB.  Its records
    come out in batches of some 16 MB.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = pa.schema([("id", pa.string()), ("record", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                ids, raw, size = [], [], 0
                for k, r in enumerate(records(content.as_py() or b"")):
                    ids.append(f"{name.as_py()}#{k}")
                    raw.append(r.bytes())
                    size += len(raw[-1])
                    if size >= 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(raw, pa.binary())], schema=schema)
                        ids, raw, size = [], [], 0
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(raw, pa.binary())], schema=schema)

    return files.mapInArrow(run, "id string, record binary")


def _rows(key: object, source: Record) -> list[tuple]:
    got = derive(source)
    if not got:
        return []
    claimed = source.get("WARC-Payload-Digest")
    return [(key, x.get("WARC-Type"), x.get("WARC-Record-ID"), x.get("WARC-Refers-To"), x.get("WARC-Target-URI"), x.get("WARC-Date"), x.get("WARC-Block-Digest"), claimed, got[2], len(x.block), x.block.decode("utf-8", "replace"), x.bytes()) for x in got[:2]]


def _derived(source: DataFrame, read, columns: list[str]) -> DataFrame:
    def make():
        def fn(*lists):
            rows = [row for given in zip(*lists, strict=True) for r in read(*given) for row in _rows(given[0], r)]
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(12)]

        return fn

    kind = dict(source.dtypes)["id"]
    schema = f"id {kind}, type string, record_id string, refers_to string, target_uri string, date string, block_digest string, source_digest string, digest_ok boolean, content_length long, block string, record binary"
    return map_batches(source, make, columns, schema, 128)


def derivatives(source: DataFrame, id_column: str = "id", record_column: str = "record") -> DataFrame:
    """Two rows for every response: id, type, record_id, refers_to, target_uri, date, block_digest, source_digest, digest_ok, content_length, block (its text), record (all its bytes)."""
    rows = source.select(F.col(id_column).alias("id"), F.col(record_column).alias("record"))
    return _derived(rows, lambda key, data: records(data or b""), ["id", "record"])


def page_derivatives(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """The derivatives of every page's response, as from ``derivatives(responses(pages))``, in one pass."""
    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    return _derived(rows, lambda key, url, source: [page_response(key, url, source)], ["id", "url", "html"])
