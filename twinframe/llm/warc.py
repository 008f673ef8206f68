"""WARC derivative builder: metadata and plain-text conversion records of responses.

A response record (headers and an HTTP block) gives two derived records. The metadata
record is a JSON document with the response's own headers, its HTTP status and headers,
and what the page holds: title, links, sizes. The conversion record is the page's visible text.
Both refer to the response (WARC-Refers-To), name each other (WARC-Concurrent-To), keep its
target and date, carry its payload digest (WARC-Refers-To-Payload-Digest) and have block
digests of their own. Record ids are derived from the source's id, so that rebuilding a
lost part gives the same records.

Scale: responses are independent; one pass without a shuffle. `read_records` gets
whole files from Spark's binary source, of 2 GB at most, and parses them record by record; `write_records` gives each record's bytes, one
gzip member each, so that records can be joined to files in any order.

Defined cases: null pages or urls give an empty payload or target; a block that isn't
HTTP is all payload, with no status; empty texts give empty conversion records; repeated
rows give equal records; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, bounded_batches, lean
from .html_extract import parse, visible_text

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122
GZIP = b"\x1f\x8b"  # fixed value: how a gzip member begins
#: Bytes read, or decompressed, at a time.
CHUNK = 1 << 16
CAPTURED = "2024-01-01T00:00:00Z"
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)

FIELDS = "record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, content_type string, content_length long, block_digest string, source_payload_digest string, source_headers string, block string"


def digest_of(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(kind: str, source: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind} {source}')}>"


def response_headers(page_id, url: str | None, payload: bytes, block: bytes) -> dict[str, str]:
    """Headers of the response record that stands for a fetched page."""
    return {
        "WARC-Type": "response",
        "WARC-Record-ID": derived_id("response", f"{page_id} {url or ''}"),
        "WARC-Target-URI": url or "",
        "WARC-Date": CAPTURED,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
        "WARC-Payload-Digest": digest_of(payload),
        "WARC-Block-Digest": digest_of(block),
    }


def http_block(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload; a block that isn't HTTP is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        head, _, payload = block.partition(b"\n\n")
    status, *lines = head.decode("latin-1").splitlines()
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], payload


def decoded(headers: list[tuple[str, str]], payload: bytes) -> str:
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    found = _CHARSET.search(kind)
    try:
        return payload.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derive(headers: dict[str, str], block: bytes) -> list[tuple]:
    """The metadata and the conversion record of one response, as rows of FIELDS."""
    source = headers.get("WARC-Record-ID", "")
    status, http, payload = split_http(block)
    page = parse(decoded(http, payload))
    text = visible_text(page)
    ids = {kind: derived_id(kind, source) for kind in ("metadata", "conversion")}
    about = {
        "Envelope": {
            "WARC-Header-Metadata": headers,
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {
                    "Response-Message": status,
                    "Headers": dict(http),
                    "Entity-Length": len(payload),
                    "Entity-Digest": digest_of(payload),
                    "HTML-Metadata": {"Head": {"Title": page.title}, "Links": [{"path": "A@/href", "url": u, "text": t} for u, t in page.links]},
                }
            },
        }
    }
    kept = json.dumps(headers, ensure_ascii=False)
    out = []
    for kind, content_type, body in (("metadata", "application/json", json.dumps(about, ensure_ascii=False)), ("conversion", "text/plain", text)):
        data = body.encode("utf-8", "replace")
        other = ids["conversion" if kind == "metadata" else "metadata"]
        out.append((kind, ids[kind], source, other, headers.get("WARC-Target-URI", ""), headers.get("WARC-Date", ""), content_type, len(data), digest_of(data), headers.get("WARC-Payload-Digest") or digest_of(payload), kept, data.decode()))
    return out


def _derivatives(frame: DataFrame, key: str, key_kind: str, load) -> DataFrame:
    """Rows (key, FIELDS); load gives (headers, block) from a batch row's other values."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = [pa.int64() if f.split()[1] == "long" else pa.string() for f in FIELDS.split(", ")]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # the output is larger than the input
                part = batch.slice(at, 512)
                keys, rows = [], []
                for k, *values in zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True):
                    for row in derive(*load(k, *values)):
                        keys.append(k)
                        rows.append(row)
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(keys, part.column(0).type), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[key, *names])

    bounded_batches(frame.sparkSession)
    return frame.mapInArrow(lean(run), f"{key} {key_kind}, {FIELDS}")


def page_derivatives(pages: DataFrame) -> DataFrame:
    """Derived records of pages, each fetched page standing as one response record."""

    def load(page_id, url, source):
        payload = (source or "").encode("utf-8", "replace")
        block = http_block(payload)
        return response_headers(page_id, url, payload, block), block

    return _derivatives(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), "page_id", "long", load)


def record_derivatives(records: DataFrame) -> DataFrame:
    """Derived records of the responses among records (headers as JSON string, block as binary)."""
    responses = records.where(F.get_json_object("headers", "$.WARC-Type") == "response")
    return _derivatives(responses.select(F.get_json_object("headers", "$.WARC-Record-ID").alias("source_id"), "headers", "block"), "source_id", "string", lambda _, headers, block: (json.loads(headers), block))


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    """A WARC/1.0 record as one gzip member."""
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def _plain(source: io.RawIOBase) -> Iterator[bytes]:
    """A file's bytes as they are or, if it is gzip, those of its members one after the other."""
    data = source.read(CHUNK)
    if data[:2] != GZIP:
        while data:
            yield data
            data = source.read(CHUNK)
        return
    member = zlib.decompressobj(31)
    while data:
        got = member.decompress(data, CHUNK)
        if got:
            yield got
        if not member.eof:
            data = member.unconsumed_tail or source.read(CHUNK)
            continue
        data = member.unused_data
        if len(data) < 2:
            data += source.read(CHUNK)
        if data[:2] != GZIP:  # what follows the last member
            return
        member = zlib.decompressobj(31)


def parse_records(source: bytes | io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file, plain or with a gzip member per record.

    Reads on as records are asked for: no more than a record and a chunk are held. A record cut off
    at the end has the block that there is; one whose headers are cut off is none.
    """
    chunks, held = _plain(io.BytesIO(source) if isinstance(source, bytes) else source), bytearray()

    def more() -> bool:
        got = next(chunks, b"")
        held.extend(got)
        return bool(got)

    while True:
        while (at := held.find(b"WARC/")) < 0:
            del held[:-4]
            if not more():
                return
        del held[:at]
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                return
        headers: dict[str, str] = {}
        for line in held[:end].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            headers[k.strip()] = v.strip()
        stated = headers.get("Content-Length", "")
        last = end + 4 + (int(stated) if stated.isascii() and stated.isdigit() else 0)
        while len(held) < last and more():
            pass
        yield headers, bytes(held[end + 4 : last])
        del held[:last]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, headers, block) of all records of the WARC files below path; a file is read by one task, its records leave it in small batches."""

    def run(batches):
        def made(path, rows):
            return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([json.dumps(h, ensure_ascii=False) for h, _ in rows], pa.string()), pa.array([b for _, b in rows], pa.binary())], names=["path", "headers", "block"])

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for record in parse_records(pa.BufferReader(content.as_buffer())):
                    rows.append(record)
                    size += len(record[1])
                    if len(rows) >= 512 or size >= BATCH_BYTES:
                        yield made(path, rows)
                        rows, size = [], 0
                yield made(path, rows)

    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(lean(run), "path string, headers string, block binary")


def write_records(derived: DataFrame) -> DataFrame:
    """derived with `record`: each derived record's bytes, one gzip member."""

    @F.udf("binary")
    def made(kind, record_id, refers_to, concurrent_to, target, date, content_type, length, block_digest, payload_digest, block):
        headers = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Refers-To": refers_to, "WARC-Concurrent-To": concurrent_to, "WARC-Target-URI": target, "WARC-Date": date, "Content-Type": content_type, "Content-Length": str(length), "WARC-Block-Digest": block_digest, "WARC-Refers-To-Payload-Digest": payload_digest}
        return record_bytes(headers, block.encode())

    return derived.withColumn("record", made("record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type", "content_length", "block_digest", "source_payload_digest", "block"))


def digest(pages: DataFrame) -> DataFrame:
    """Two rows per page: its metadata record and its conversion record."""
    return page_derivatives(pages)
