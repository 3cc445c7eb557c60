"""WARC derivatives: of each response a linked metadata record and a plain-text conversion record.

Both refer to the response by its record id and keep its target URI and date. The metadata record's JSON holds the
response's WARC and HTTP headers, its digests as stated and as computed, and the page's title and links. The conversion
record is the page's text.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import configured, schema, texts_of, trimming

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space for URLs of RFC 4122
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_LINK = re.compile(r"""\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
#: Elements whose content is no text, and those that begin a new line. Fixed values of HTML.
HIDDEN = frozenset("script style noscript template title".split())
BLOCK = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul title".split())
_CLOSING = {name: re.compile(rf"</{name}\b", re.IGNORECASE) for name in HIDDEN}
_CHARSET = re.compile(rb"""charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", re.IGNORECASE)
_CHUNK = re.compile(rb"([0-9A-Fa-f]{1,15})[ \t]*(?:;[^\r\n]*)?\r?\n")


@dataclass
class Record:
    """A WARC record: named headers in order, and the block."""

    headers: list[tuple[str, str]]
    block: bytes = b""

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)

    def to_bytes(self) -> bytes:
        head = [(k, v) for k, v in self.headers if k.lower() != "content-length"] + [("Content-Length", str(len(self.block)))]
        return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + self.block + b"\r\n\r\n"


@dataclass
class Page:
    text: str
    title: str
    links: list[str] = field(default_factory=list)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same for the same parts, so that a task that runs again writes the same records."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def _fields(head: str) -> list[tuple[str, str]]:
    """Named fields in order; a line that begins with white space goes on with the one before it."""
    head = re.sub(r"\r\n[ \t]+", " ", head)
    return [(k.strip(), v.strip()) for line in head.split("\r\n") if ":" in line for k, v in [line.split(":", 1)]]


def inflated(data: bytes, bits: int = 47) -> bytes:
    """What the members of gzip or zlib data hold, up to where they are damaged."""
    out = []
    while data:
        member = zlib.decompressobj(bits)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        if not member.eof:
            break
        data = member.unused_data
    return b"".join(out)


def unchunked(data: bytes) -> bytes:
    """The body of chunked transfer coding; data that does not begin with a chunk is as it is, and a damaged body ends at
    the damage."""
    out, at = [], 0
    while m := _CHUNK.match(data, at):
        size = int(m[1], 16)
        out.append(data[m.end() : m.end() + size])
        at = m.end() + size
        if not size:
            break
        at += 2 if data.startswith(b"\r\n", at) else data.startswith(b"\n", at)
    return b"".join(out) if at else data


def content_of(fields: list[tuple[str, str]], payload: bytes) -> str:
    """A payload's text by its HTTP fields: transfer coding and gzip or deflate undone, decoded by the character set of
    the fields, else of the first 1,024 bytes, else as UTF-8. Other content codings (br, zstd) give the empty text."""
    named = {k.lower(): v for k, v in reversed(fields)}
    if "chunked" in named.get("transfer-encoding", "").lower():
        payload = unchunked(payload)
    for coding in reversed([c.strip().lower() for c in named.get("content-encoding", "").split(",")]):
        if coding in ("gzip", "x-gzip"):
            payload = inflated(payload) if payload.startswith(b"\x1f\x8b") else payload  # some are stored undone
        elif coding == "deflate":
            payload = inflated(payload) or inflated(payload, -15)
        elif coding not in ("", "identity"):
            return ""
    if payload.startswith(b"\xef\xbb\xbf"):
        return payload[3:].decode("utf-8", "replace")
    name = _CHARSET.search(named.get("content-type", "").encode()) or _CHARSET.search(payload, 0, 1024)
    try:
        return payload.decode(name[1].decode() if name else "utf-8", "replace")
    except (LookupError, ValueError):
        return payload.decode("utf-8", "replace")


def read_records(data: bytes) -> Iterator[Record]:
    """The records of a WARC file, plain or gzip; ends at what is no record and at one that is cut off."""
    if data.startswith(b"\x1f\x8b"):
        data = inflated(data)
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = _fields(data[at:end].decode("utf-8", "replace").split("\r\n", 1)[-1])
        record = Record(headers)
        size = record.get("Content-Length") or "0"
        size = int(size) if size.isascii() and size.isdigit() else 0
        if end + 4 + size > len(data):
            return
        record.block = data[end + 4 : end + 4 + size]
        yield record
        at = end + 4 + size + 4


def page_of(source: str) -> Page:
    """Text, title and links of an HTML page, in one pass.

    Elements that never end run to the end of the page, but for the head, which has no text of its own. A tag whose quotes
    never close ends at its first `>`, and so do all tags after it.
    """
    out: list[str] = []
    links: list[str] = []
    i, n = 0, len(source)
    title, quoted = None, True
    while i < n:
        j = source.find("<", i)
        if j < 0:
            out.append(source[i:])
            break
        out.append(source[i:j])
        if source.startswith("<!--", j):
            k = source.find("-->", j + 4)
            i = n if k < 0 else k + 3
            continue
        m = _TAG.match(source, j)
        if not m:
            if source[j + 1 : j + 2] in ("!", "?"):
                k = source.find(">", j)
                i = n if k < 0 else k + 1
            else:
                out.append("<")
                i = j + 1
            continue
        rest = _REST.match(source, m.end()) if quoted else None
        quoted = rest is not None
        i = rest.end() if rest else n if (k := source.find(">", m.end())) < 0 else k + 1
        name = m[2].lower()
        if name in BLOCK:
            out.append("\n")
        if name == "a" and not m[1] and (h := _LINK.search(source, m.end() - 1, i)):
            links.append(html.unescape(h[1] or h[2] or h[3] or ""))
        if name in HIDDEN and not m[1]:
            closing = _CLOSING[name].search(source, i)
            begin, i = i, closing.start() if closing else n
            if name == "title" and title is None:
                title = source[begin:i]
    lines = (" ".join(line.split()) for line in html.unescape("".join(out)).split("\n"))
    return Page("\n".join(x for x in lines if x), " ".join(html.unescape(title or "").split()), links)


def response(url: str, source: bytes, date: str) -> Record:
    """A response record for a page that was stored without its headers."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(source)
    block = http + source
    return Record(
        [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", url, digest(source))), ("WARC-Date", date), ("WARC-Target-URI", url.replace("\r", "").replace("\n", "")), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(source)), ("WARC-Block-Digest", digest(block))],
        block,
    )


def derivatives(record: Record) -> tuple[Record, Record, dict] | None:
    """The metadata and conversion records of a response, and what the first one says; None for records of other types.

    A stated payload digest may be that of the stored bytes or of those without transfer coding.
    """
    if (record.get("WARC-Type") or "").lower() != "response":
        return None
    head, _, payload = record.block.partition(b"\r\n\r\n")
    status, _, rest = head.decode("utf-8", "replace").partition("\r\n")
    fields = _fields(rest)
    page = page_of(content_of(fields, payload))
    own = record.get("WARC-Record-ID") or record_id("response", digest(record.block))
    common = [(k, v) for k in ("WARC-Date", "WARC-Target-URI") if (v := record.get(k)) is not None]
    computed = {"WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(record.block)}
    wrong = [k for k, v in computed.items() if record.get(k) not in (None, v)]
    if "WARC-Payload-Digest" in wrong and any(k.lower() == "transfer-encoding" for k, _ in fields) and record.get("WARC-Payload-Digest") == digest(unchunked(payload)):
        wrong.remove("WARC-Payload-Digest")
    envelope = {"WARC-Header-Metadata": record.headers, "HTTP-Response-Metadata": {"Status": status, "Headers": fields}, "Computed-Digests": computed, "Digest-Mismatch": wrong, "Title": page.title, "Links": page.links}

    def made(kind: str, content: str, block: bytes) -> Record:
        return Record([("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, own)), *common, ("WARC-Refers-To", own), ("Content-Type", content), ("WARC-Block-Digest", digest(block))], block)

    return made("metadata", "application/json", json.dumps(envelope, ensure_ascii=False).encode()), made("conversion", "text/plain; charset=utf-8", page.text.encode()), envelope


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """page_id, warc (a response record's bytes) of every row (page_id, url, html); null url or html is empty, and page_id
    may be null. Rows that repeat give equal records; an empty table gives no rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [response(u.decode("utf-8", "replace"), h, date).to_bytes() for u, h in zip(texts_of(batch.column(1)), texts_of(batch.column(2)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["page_id", "warc"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(trimming(run), schema("page_id long, warc binary"))


def derived(records: DataFrame, key: str = "page_id") -> DataFrame:
    """Of each response in the column warc (one record or many in a row): its row's key, response_id, target_uri,
    payload_digest (computed), digest_ok, and the bytes of the records metadata and conversion.

    Records of other types, null and damaged rows give nothing; rows that repeat give the same records again. An empty
    table gives no rows; other columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = tuple([] for _ in range(7))
            for k, data in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                for record in read_records(data):
                    if (made := derivatives(record)) is not None:
                        computed, ok = made[2]["Computed-Digests"]["WARC-Payload-Digest"], "WARC-Payload-Digest" not in made[2]["Digest-Mismatch"]
                        for column, v in zip(rows, (k, made[0].get("WARC-Refers-To"), record.get("WARC-Target-URI"), computed, ok, made[0].to_bytes(), made[1].to_bytes()), strict=True):
                            column.append(v)
            types = (batch.column(0).type, pa.string(), pa.string(), pa.string(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], [key, "response_id", "target_uri", "payload_digest", "digest_ok", "metadata", "conversion"])

    kind = records.schema[key].dataType.simpleString()
    return records.select(key, "warc").mapInArrow(trimming(run), schema(f"{key} {kind}, response_id string, target_uri string, payload_digest string, digest_ok boolean, metadata binary, conversion binary"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers and digests of the derivatives of every page."""
    pages = configured(spark).read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    made = derived(responses(pages))
    return made.select("page_id", "response_id", "target_uri", "payload_digest", "digest_ok", F.octet_length("metadata").cast("long").alias("metadata_bytes"), F.sha2("metadata", 256).alias("metadata_sha256"), F.octet_length("conversion").cast("long").alias("conversion_bytes"), F.sha2("conversion", 256).alias("conversion_sha256"))
