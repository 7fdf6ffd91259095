"""WARC derivatives: metadata and plain-text conversion records from response records.

Every response gives two records that name it in WARC-Refers-To and carry its target URI, date and payload digest: `metadata`, a JSON
object with the source's WARC and HTTP headers, title, meta tags and links; and `conversion`, the page as plain text. Record
ids follow from the source's id and the kind, so that a rerun gives the same records. Chunked bodies are joined, and compressed ones decompressed for the text
and metadata; the payload digest is of the body as it was sent, without its chunks. A record that can't be read gives a row with the error.

Files of records, compressed one by one or not at all, are read as a stream, one task a file, and written as parts with a member for each record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import urljoin

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.pcap import open_file
from .common import small_batches, table

VERSION = "WARC/1.1"
_NAMES = uuid.UUID("6f1d2c8e-4b0a-5d7c-9e3f-2a1b0c9d8e7f")
_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z!?][^>]*>")
_SPACE = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_META = re.compile(r"<meta\b([^>]*)>", re.I)
_LINK = re.compile(r"<(a|link|img|iframe)\b([^>]*)>", re.I)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_CHARSET = re.compile(rb"charset=[\"']?([-\w]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record; Content-Length is added."""
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers, in order, and block of a record. Folded header lines are joined; a record that is cut short is an error."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
    length = int(next((v for k, v in headers if k.lower() == "content-length"), len(rest)))
    if len(rest) < length:
        raise ValueError("the record is cut short")
    return headers, rest[:length]


def http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        head, gap, body = block.partition(b"\n\n")
    lines = head.decode("latin-1").replace("\r\n", "\n").split("\n")
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]) if k], body


def joined(body: bytes) -> bytes:
    """A chunked body without its chunk sizes; of a broken one, the chunks before the damage."""
    out, at = [], 0
    while True:
        end = body.find(b"\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        try:
            n = int(size, 16)
        except ValueError:
            return b"".join(out)
        if n <= 0:
            return b"".join(out)
        out.append(body[end + 1 : end + 1 + n])
        at = end + 1 + n
        while body[at : at + 1] in (b"\r", b"\n") and at < len(body):
            at += 1


def _inflated(body: bytes, bits: int) -> bytes:
    """All members of a compressed body; of a damaged one, what comes before the damage."""
    out = []
    while body:
        press = zlib.decompressobj(bits)
        try:
            out += [press.decompress(body), press.flush()]
        except zlib.error:
            if not out and bits == 15:
                return _inflated(body, -15)  # deflate without its header is common
            break
        if not press.eof or press.unused_data == body:
            break
        body = press.unused_data if bits == 31 else b""
    return b"".join(out)


def decompressed(body: bytes, codings: list[str]) -> bytes:
    """A body with its codings undone, the last first. An unknown one, or one that the body doesn't have, is left as it is."""
    for coding in reversed(codings):
        if coding in ("gzip", "x-gzip") and body[:2] == b"\x1f\x8b":
            body = _inflated(body, 31)
        elif coding == "deflate":
            body = _inflated(body, 15) or body
        elif coding == "zstd" and body[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard

            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    return body


def _values(headers: list[tuple[str, str]], name: str) -> list[str]:
    return [x.strip().lower() for k, v in headers if k.lower() == name for x in v.split(",") if x.strip()]


def decode(body: bytes, content_type: str = "") -> str:
    found = _CHARSET.search(content_type.encode()) or _CHARSET.search(body[:2048])
    try:
        return body.decode(found[1].decode() if found else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def plain_text(page: str) -> str:
    """Text of a page: without comments, scripts and styles, a line for each block."""
    text = _TAG.sub("", _BREAK.sub("\n", _DROP.sub(" ", page.replace("\n", " "))))
    return _LINES.sub("\n", _SPACE.sub(" ", html.unescape(text))).strip()


def _attributes(tag: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(tag)}


def page_metadata(page: str, uri: str) -> dict:
    page = _DROP.sub(" ", page)
    title = _TITLE.search(page)
    meta = [a for m in _META.finditer(page) if (a := _attributes(m[1]))]
    links = []
    for m in _LINK.finditer(page):
        a = _attributes(m[2])
        url = a.get("href") or a.get("src")
        if url:
            try:
                links.append({"path": m[1].lower(), "url": urljoin(uri, url)})
            except ValueError:  # not a URL that can be joined
                links.append({"path": m[1].lower(), "url": url})
    return {"title": _SPACE.sub(" ", html.unescape(title[1])).strip() if title else None, "metas": meta, "links": links}


def _by_name(headers: list[tuple[str, str]]) -> dict[str, str | list[str]]:
    """Headers by name in any case, under its first spelling: the value, or all of them in order where the name is there several times."""
    out: dict[str, tuple[str, list[str]]] = {}
    for k, v in headers:
        out.setdefault(k.lower(), (k, []))[1].append(v)
    return {k: v if len(v) > 1 else v[0] for k, v in out.values()}


def derive_record(data: bytes) -> list[dict]:
    """The metadata and the conversion record of a response; none of another type."""
    headers, block = parse(data)
    by = {k.lower(): v for k, v in headers}
    if by.get("warc-type") != "response":
        return []
    status, fields, body = http(block)
    if "warc-record-id" not in by:
        raise ValueError("the record has no WARC-Record-ID")
    if "chunked" in _values(fields, "transfer-encoding"):
        body = joined(body)
    kind = next((v for k, v in fields if k.lower() == "content-type"), "")
    source, uri, date = by["warc-record-id"], by.get("warc-target-uri"), by.get("warc-date", "")
    payload = by.get("warc-payload-digest") or digest(body)
    page = decode(decompressed(body, _values(fields, "content-encoding")), kind)
    envelope = {
        "envelope": {"warc-header": _by_name(headers), "payload-digest": payload, "http-response": {"status": status, "headers": _by_name(fields), "entity-length": len(body), "entity-digest": digest(body)}},
        "html": page_metadata(page, uri or ""),
    }
    out = []
    for what, block_type, content in (("metadata", "application/json", json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode()), ("conversion", "text/plain; charset=utf-8", plain_text(page).encode())):
        row = {"type": what, "record_id": f"<urn:uuid:{uuid.uuid5(_NAMES, f'{source} {what}')}>", "refers_to": source, "target_uri": uri, "date": date, "content_type": block_type, "content_length": len(content), "block_digest": digest(content), "source_payload_digest": payload}
        lines = [("WARC-Type", what), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", date), ("WARC-Refers-To", source), *([("WARC-Target-URI", uri)] if uri else []), ("WARC-Block-Digest", row["block_digest"]), ("WARC-Source-Payload-Digest", payload), ("Content-Type", block_type)]
        out.append(row | {"record": record(lines, content)})
    return out


def response(page_id: int | None, url: str | None, page: str | None, date: str) -> bytes:
    """A response record of a page; a null page has an empty body, a null url no target URI."""
    body = (page or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    target = [("WARC-Target-URI", re.sub(r"\s", "%20", url))] if url else []
    name = uuid.uuid5(_NAMES, f"{page_id} {url} {digest(body)}")
    return record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", date), *target, ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")], block)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(page_id, record): each page as a WARC response record. Other columns are ignored; repeated rows give repeated records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [response(i, u, h, date) for i, u, h in zip(*(batch.column(c).to_pylist() for c in range(3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["page_id", "record"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, record binary")


def _plain(stream: BinaryIO, size: int) -> Iterator[bytes]:
    """A stream's bytes in parts of about `size`, decompressed if it is gzip, member after member."""
    raw = stream.read(size)
    if raw[:2] != b"\x1f\x8b":
        while raw:
            yield raw
            raw = stream.read(size)
        return
    press = zlib.decompressobj(31)
    while raw:
        try:
            part = press.decompress(raw, size)
        except zlib.error as e:
            raise ValueError(f"the file is damaged: {e}") from e
        if part:
            yield part
        raw = press.unconsumed_tail or press.unused_data or stream.read(size)
        if press.eof and raw:
            press = zlib.decompressobj(31)


def records(stream: BinaryIO, size: int = 1 << 20) -> Iterator[bytes]:
    """The records of a WARC file, whole, one by one: a stream of records, plain or compressed by gzip as members or all together.
    A file that is cut short gives the records before the cut; then a ValueError."""
    parts, held = _plain(stream, size), bytearray()
    while True:
        while held[:1] in (b"\r", b"\n"):
            del held[:1]
        end = held.find(b"\r\n\r\n")
        if end >= 0:
            found = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", bytes(held[:end]).replace(b"\r", b""))
            if not held.startswith(b"WARC/") or not found:
                raise ValueError("not a WARC record")
            total = end + 4 + int(found[1])
            if len(held) >= total:
                yield bytes(held[:total])
                del held[:total]
                continue
        part = next(parts, None)
        if part is None:
            if held:
                raise ValueError("the file is cut short")
            return
        held += part


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, record, error) of WARC files: a row for each record, in bounded memory. What can't be read of a file is one row with the error and no record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(name, first, held, error=None):
            n = len(held)
            return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(held, pa.binary()), pa.array([error] * n, pa.string())], ["file", "ordinal", "record", "error"])

        for batch in batches:
            for name in batch.column(0).to_pylist():
                held, n, at = [], 0, 0
                try:
                    with open_file(name) as f:
                        for r in records(f):
                            held.append(r)
                            at += len(r)
                            if at > 8 << 20:
                                yield out(name, n, held)
                                n, held, at = n + len(held), [], 0
                    yield out(name, n, held)
                except ValueError as e:
                    yield out(name, n, held)
                    yield out(name, n + len(held), [None], str(e))

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.repartition(max(1, min(files.count(), 10_000)), "path").mapInArrow(run, "file string, ordinal long, record binary, error string")


def write_warc(rows: DataFrame, path: str, column: str = "record") -> DataFrame:
    """Writes the records of each task to a part file under `path`, a gzip member each; (file, records). A part comes into place when it is whole, and a repeated task
    writes the same part again. Null records are left out."""
    import os

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        name, n = f"{path.removeprefix('file://').removeprefix('file:')}/part-{TaskContext.get().partitionId():05d}.warc.gz", 0
        store, name = fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name)
        store.create_dir(os.path.dirname(name))
        partial = f"{name}.{TaskContext.get().taskAttemptId()}.partial"
        with store.open_output_stream(partial) as out:
            for batch in batches:
                for r in batch.column(0).to_pylist():
                    if r is not None:
                        out.write(gzip.compress(r, 6, mtime=0))
                        n += 1
        store.move(partial, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["file", "records"])

    return rows.select(F.col(column)).mapInArrow(run, "file string, records long")


_TEXT = ("type", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest", "source_payload_digest")


def derive(records: DataFrame, key: str = "page_id") -> DataFrame:
    """Two rows for each response record, metadata and conversion: the key, type, record_id, refers_to, target_uri, date, content_type, content_length,
    block_digest, source_payload_digest, record, the whole WARC record as bytes, and error.

    records: key and record (bytes of one WARC record); other columns are ignored. Records of another type and null records give no rows; bytes that can't be read as a
    record give one row of the key and the error. Repeated records give repeated rows, a null key stays null, pages of any length are taken whole, and an empty
    table gives an empty table."""

    def derived(data: bytes) -> list[dict]:
        try:
            return derive_record(data)
        except ValueError as e:
            return [{"error": str(e)}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, blobs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s in range(0, len(keys), 512):
                rows = [{"key": k} | d for k, b in zip(keys[s : s + 512], blobs[s : s + 512]) if b is not None for d in derived(b)]
                text = [pa.array([r.get(c) for r in rows], pa.string()) for c in (*_TEXT, "error")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["key"] for r in rows], pa.int64()), *text[:-1], pa.array([r.get("content_length") for r in rows], pa.int64()), pa.array([r.get("record") for r in rows], pa.binary()), text[-1]],
                    [key, *_TEXT, "content_length", "record", "error"],
                )

    small_batches(records.sparkSession)
    schema = f"{key} long, " + ", ".join(f"{c} string" for c in _TEXT) + ", content_length long, record binary, error string"
    return records.select(F.col(key).cast("long").alias(key), F.col("record").cast("binary").alias("record")).mapInArrow(run, schema)


def op3_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages"))).withColumn("record_sha256", F.sha2("record", 256)).drop("record")
