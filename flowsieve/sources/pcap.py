"""Packet captures as an edge source: spark.read.format("pcap").

Formats, fixed by the file format: four magic numbers (byte order, micro- or nanoseconds), a 24-byte header, 16-byte record headers. An uncompressed
file whose first records have one size is split into ranges of whole records; any other file, and a compressed one, is one partition
read in bounded chunks. A capture cut short gives the records that are whole.

Records may change their size later on. read_pcap() looks for that first, range by range: what lies before the first record of
another size is read in ranges, all from there on by one task, record by record. The format by itself fails on such a range.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed: magic bytes to byte order and nanoseconds; link types to where IPv4 starts (14 for the rest).
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", False), b"\xa1\xb2\xc3\xd4": (">", False), b"\x4d\x3c\xb2\xa1": ("<", True), b"\xa1\xb2\x3c\x4d": (">", True)}
LINK_OFFSETS = {0: 4, 1: 14, 12: 0, 101: 0, 113: 16, 228: 0}
HEADER, RECORD = 24, 16
CHUNK, PROBE, SPLIT = 8 << 20, 64, 64 << 20
SCHEMA = "seq bigint, src bigint, dst bigint, weight bigint"
CHECKED = "start bigint, changed bigint"


@dataclass(frozen=True)
class Header:
    order: str
    nanoseconds: bool
    link_type: int
    ip_offset: int


def read_header(data: bytes) -> Header:
    if len(data) < HEADER or data[:4] not in MAGIC:
        raise ValueError("not a pcap file: bad magic number")
    order, nano = MAGIC[data[:4]]
    link = struct.unpack(order + "I", data[20:24])[0] & 0xFFFF
    return Header(order, nano, link, LINK_OFFSETS.get(link, 14))


def _sizes(data: bytes, h: Header, most: int = PROBE) -> list[tuple[int, int]]:
    """(start, captured length) of the first whole records of data, which starts at a record."""
    out, at = [], 0
    while len(out) < most and at + RECORD <= len(data):
        n = struct.unpack(h.order + "I", data[at + 8 : at + 12])[0]
        if at + RECORD + n > len(data):
            break
        out.append((at, n))
        at += RECORD + n
    return out


def uniform_size(data: bytes, h: Header) -> int | None:
    """Bytes of a record with its header if the first ones, two at least, agree."""
    found = _sizes(data, h)
    sizes = {n for _, n in found}
    return RECORD + sizes.pop() if len(found) >= 2 and len(sizes) == 1 else None


def find_ip(data: bytes, h: Header, share: float = 0.9) -> int:
    """Where IPv4 starts in a packet: the link type's place, or another usual one, where at least `share` of packets have version 4."""
    found = _sizes(data, h)
    for offset in dict.fromkeys((h.ip_offset, 4, 14, 0, 16)):
        hits = sum(1 for at, n in found if n > offset and data[at + RECORD + offset] >> 4 == 4)
        if found and hits >= share * len(found):
            return offset
    raise ValueError(f"no IPv4 in the packets; the first bytes are {data[:64].hex(' ')}")


def parse_uniform(data: bytes, h: Header, size: int, ip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Sources, destinations and original lengths of records of one size; None if a record differs."""
    n = len(data) // size
    m = np.frombuffer(data, np.uint8, n * size).reshape(n, size)
    word = lambda at, order: np.ascontiguousarray(m[:, at : at + 4]).view(order + "u4").ravel().astype(np.int64)
    if (word(8, h.order) != size - RECORD).any():
        return None
    return word(RECORD + ip + 12, ">"), word(RECORD + ip + 16, ">"), word(12, h.order)


def parse_any(data: bytes, h: Header, ip: int) -> tuple[list[tuple[int, int, int]], int]:
    """(source, destination, original length) of whole records, packets too short for addresses left out, and the bytes used."""
    out, at = [], 0
    while at + RECORD <= len(data):
        n, whole = struct.unpack(h.order + "II", data[at + 8 : at + 16])
        if at + RECORD + n > len(data):
            break
        if n >= ip + 20:
            out.append((*struct.unpack(">II", data[at + RECORD + ip + 12 : at + RECORD + ip + 20]), whole))
        at += RECORD + n
    return out, at


def open_file(path: str) -> BinaryIO:
    """A file of any store that has a URI scheme, or a local one."""
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        if path.startswith("file:"):
            return open(path.removeprefix("file://").removeprefix("file:"), "rb")
        store, name = fs.FileSystem.from_uri(path)
        return store.open_input_file(name)
    return open(path, "rb")


def file_size(path: str) -> int:
    with open_file(path) as f:
        return f.seek(0, 2)


def chunks(path: str, size: int = CHUNK, start: int = 0) -> Iterator[bytes]:
    """Bytes of a file from `start` on, decompressed if it is zstd; of a damaged one, all before the damage."""
    with open_file(path) as f:
        if not path.endswith((".zst", ".zstd")):
            f.seek(start)
            while part := f.read(size):
                yield part
            return
        import zstandard

        reader = zstandard.ZstdDecompressor().stream_reader(f)
        while True:
            try:
                part = reader.read(size)
            except zstandard.ZstdError:
                return
            if not part:
                return
            yield part


def edges(parts: Iterator[bytes], limit: int | None = None, known: tuple[Header, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays of sources, destinations and weights of a capture given as chunks. known: the header and IPv4 offset of chunks that start at a record of any size."""
    held, h, ip, size, left = b"", None, 0, None, limit
    if known:
        (h, ip), size = known, 0
    for part in parts:
        held += part
        if h is None:
            if len(held) < HEADER:
                continue
            h, held = read_header(held), held[HEADER:]
        if size is None:
            if len(_sizes(held, h)) < PROBE:
                continue  # too few records yet to tell their layout
            ip, size = find_ip(held, h), uniform_size(held, h) or 0
        while held and left != 0:
            got, used = None, 0
            if size:
                if len(held) < size:
                    break
                got, used = parse_uniform(held, h, size, ip), len(held) // size * size
                if got is None:
                    size = 0  # sizes vary from here on
            if got is None:
                rows, used = parse_any(held, h, ip)
                if not used:
                    break
                got = tuple(np.array([r[i] for r in rows], np.int64) for i in range(3))
            held = held[used:]
            if left is not None:
                got = tuple(g[:left] for g in got)
                left -= len(got[0])
            yield got
        if left == 0:
            return
    if h is None:
        read_header(held)
    elif size is None and held:
        ip = find_ip(held, h)
        rows, _ = parse_any(held, h, ip)
        rows = rows[:left]
        yield tuple(np.array([r[i] for r in rows], np.int64) for i in range(3))


def layout(path: str) -> tuple[Header, int, int | None]:
    """Header, IPv4 offset and the size of the first records if they agree, from the file's first megabyte."""
    with open_file(path) as f:
        h, head = read_header(f.read(HEADER)), f.read(1 << 20)
    return h, find_ip(head, h), uniform_size(head, h)


def first_change(data: bytes, h: Header, size: int) -> int | None:
    """Where in data the first record of another size starts; data holds whole records of `size` bytes as far as they agree."""
    m = np.frombuffer(data, np.uint8, len(data) // size * size).reshape(-1, size)
    found = np.flatnonzero(np.ascontiguousarray(m[:, 8:12]).view(h.order + "u4").ravel() != size - RECORD)
    return int(found[0]) * size if len(found) else None


class _Range(InputPartition):
    def __init__(self, path: str, first: int, start: int, end: int | None):
        self.path, self.first, self.start, self.end = path, first, start, end


class PcapReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")
        self.limit = int(options["limit"]) if "limit" in options else None
        self.split = int(options.get("split", SPLIT))
        self.check = options.get("check") == "true"
        self.until = int(options["until"]) if "until" in options else None
        if not self.path:
            raise ValueError("the pcap source needs a path")

    def partitions(self):
        if self.path.endswith((".zst", ".zstd")) or self.limit is not None:
            return [_Range(self.path, 0, 0, None)]
        h, _, size = layout(self.path)
        total = file_size(self.path) - HEADER
        if not size:
            return [_Range(self.path, 0, 0, None)]
        whole = total // size if self.until is None else (self.until - HEADER) // size
        per = max(1, self.split // size)
        ranges = [_Range(self.path, i, HEADER + i * size, HEADER + min(i + per, whole) * size) for i in range(0, whole, per)]
        # What is left: a record cut short, smaller records, or all from the first change on.
        return ranges + ([_Range(self.path, whole, HEADER + whole * size, None)] if total > whole * size and not self.check else [])

    def read(self, part):
        seq = part.first
        if part.end is None:
            if part.start:
                h, ip, _ = layout(self.path)
                found = edges(chunks(self.path, start=part.start), None, (h, ip))
            else:
                found = edges(chunks(self.path), self.limit)
        else:
            h, ip, size = layout(self.path)
            with open_file(self.path) as f:
                f.seek(part.start)
                data = f.read(part.end - part.start)
            if self.check:
                at = first_change(data, h, size)
                yield pa.RecordBatch.from_arrays([pa.array([part.start]), pa.array([None if at is None else part.start + at], pa.int64())], ["start", "changed"])
                return
            got = parse_uniform(data, h, size, ip)
            if got is None:
                raise ValueError(f"records of {self.path} change their size; read it with read_pcap()")
            found = [got]
        for src, dst, weight in found:
            if len(src):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(seq, seq + len(src))), pa.array(src), pa.array(dst), pa.array(weight)], ["seq", "src", "dst", "weight"])
                seq += len(src)


class PcapSource(DataSource):
    """Options: path, limit (packets), split (bytes of a partition), until (where records change their size), check (true: a row (start, changed) for
    each range, with the place of its first record of another size)."""

    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return CHECKED if self.options.get("check") == "true" else SCHEMA

    def reader(self, schema):
        return PcapReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(PcapSource)


def _change(spark, path: str, options: dict) -> int | None:
    """Where the first record of another size starts, if the capture is one that would be split. A job over ranges; the earliest counts, as only what comes
    before it is aligned."""
    from pyspark.sql import functions as F

    if path.endswith((".zst", ".zstd")) or not layout(path)[2]:
        return None
    return spark.read.format("pcap").options(**options, check="true").load(path).agg(F.min("changed")).first()[0]


def read_pcap(spark, path: str, limit: int | None = None, split: int | None = None):
    """Edges of a capture (seq, src, dst, weight), whether its records keep their size or not."""
    register(spark)
    options = {} if split is None else {"split": str(split)}
    reader = spark.read.format("pcap").options(**options)
    if limit is not None:
        return reader.option("limit", limit).load(path)
    change = _change(spark, path, options)
    return (reader if change is None else reader.option("until", change)).load(path)


def provenance(spark, path: str) -> dict:
    """What a manifest says about a capture: fixed field names."""
    register(spark)
    with_head = next(chunks(path, 1 << 20), b"")
    h, head = read_header(with_head[:HEADER]), with_head[HEADER:]
    ip, size = find_ip(head, h), uniform_size(head, h)
    found = _sizes(head, h)
    hits = sum(1 for at, n in found if n > ip and head[at + RECORD + ip] >> 4 == 4)
    parser = "struct" if size is None else "numpy" if _uniform_throughout(spark, path) else "numpy_then_struct"
    return {
        "pcap_magic_hex": with_head[:4].hex(),
        "byte_order": h.order,
        "nanosecond": h.nanoseconds,
        "linktype": h.link_type,
        "ip_offset": ip,
        "ipv4_fraction_probe": hits / max(1, len(found)),
        "record_size_detected": size,
        "parser_path": parser,
        "packets_parsed": read_pcap(spark, path).count(),
    }


def _uniform_throughout(spark, path: str) -> bool:
    if not path.endswith((".zst", ".zstd")):
        return _change(spark, path, {}) is None
    held, h = b"", None
    for part in chunks(path):
        held += part
        if h is None:
            h, held = read_header(held), held[HEADER:]
            size = uniform_size(held, h)
        if first_change(held, h, size) is not None:
            return False
        held = held[len(held) // size * size :]
    return True
