"""Vectorised text kernels over Arrow string columns.

A batch of texts is one array of UTF-8 bytes with offsets. Words are runs of bytes other than ASCII
white space, so that byte positions suffice. Hashes of short ranges are 64-bit polynomials of table values,
taken from prefix sums and finished by a mixer. A polynomial modulo 2**64 collides on long self-similar strings
(Thue-Morse), so that ranges of more than SHORT bytes go through XXH3 instead. Everything is a few NumPy passes over a slice
of bounded size; a single text that is larger is hashed BLOCK by BLOCK, which leaves some ten bytes of memory for a byte of it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Longest range hashed by polynomial; bytes of prefix sums at once.
SHORT, BLOCK = 32, 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: Python workers outlive their tasks."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
    pa.default_memory_pool().release_unused()


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of at most `limit` bytes of text (one row at least), with their bytes and offsets."""
    data, offs = string_bytes(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        to = min(to, n)
        yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to
    give_back()


class Prefix:
    """Prefix sums from which the hash of any byte range follows."""

    def __init__(self, values: np.ndarray, table: np.ndarray | None = _TABLE, base: int = _P):
        n = len(values)
        self.base = base
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((table[values] if table is not None else values) * powers(base, n), out=self.sums[1:])
        self.inverse = powers(pow(base, -1, 1 << 64), n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, short: int | None = None) -> np.ndarray:
    """64-bit hashes of byte ranges that are apart and ascend. Only hashes of equal `short` (SHORT by default) can be compared."""
    from xxhash import xxh3_64_intdigest

    out = np.empty(len(starts), np.uint64)
    far = ends - starts > (SHORT if short is None else short)
    near = np.flatnonzero(~far)
    s, e = starts[near], ends[near]
    at = 0
    while at < len(s):
        base = s[at]
        to = int(np.searchsorted(s, base + BLOCK))
        out[near[at:to]] = Prefix(data[base : e[to - 1]]).of(s[at:to] - base, e[at:to] - base)
        at = to
    for i in np.flatnonzero(far).tolist():
        out[i] = xxh3_64_intdigest(data[starts[i] : ends[i]])
    return out


class Words:
    """Starts, ends and offsets by document of the words of a slice."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        space = SPACE[data]
        before = np.empty(len(data), bool)
        before[:1], before[1:] = True, space[:-1]
        heads = offs[:-1][offs[:-1] < len(data)]
        before[heads] = True
        after = np.empty(len(data), bool)
        after[-1:], after[:-1] = True, before[1:] & ~space[:-1] | space[1:]
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(~space & after) + 1
        self.offs = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.offs)
        self.space = space

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        return hash_ranges(data, self.starts, self.ends)


def windows(hashes: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `size` items inside a document, and the index of its first item."""
    counts = np.maximum(np.diff(offs) - size + 1, 0)
    total = int(counts.sum())
    first = np.arange(total) + np.repeat(offs[:-1] - (np.cumsum(counts) - counts), counts)
    return Prefix(hashes, None, 0xC2B2AE3D27D4EB4F).of(first, first + size), first


def sum_by_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of an array between offsets."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    flags = np.zeros(len(keys), bool)
    if len(keys):
        twice = np.zeros(len(keys), bool)
        twice[1:] |= same
        twice[:-1] |= same
        flags[order] = twice
    return flags


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each document's `size`-word shingles in lower case; of fewer words, of all of them as one."""
    data = LOWER[data]
    words = Words(data, offs)
    hashes = words.hashes(data)
    grams, _ = windows(hashes, words.offs, size)
    at = np.concatenate(([0], np.cumsum(np.maximum(words.counts - size + 1, 0))))
    out = []
    whole = None
    for d, n in enumerate(words.counts):
        if n >= size:
            out.append(np.unique(grams[at[d] : at[d + 1]]))
        elif n:
            whole = whole or Prefix(hashes, None, 0xC2B2AE3D27D4EB4F)
            out.append(whole.of(words.offs[d : d + 1], words.offs[d + 1 : d + 2]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def pack_ints(values: np.ndarray) -> bytes:
    """An integer array by byte planes, compressed."""
    import zstandard

    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T).tobytes())


def unpack_ints(packed: bytes, dtype) -> np.ndarray:
    import zstandard

    dtype = np.dtype(dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit keys by their differences."""
    return pack_ints(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(packed, np.uint64), dtype=np.uint64)


def merge_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their summed counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[heads], np.add.reduceat(count, heads) if len(heads) else np.zeros(0, np.int64)


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of ascending 64-bit keys, by ranges of equal width; ascending."""
    return np.minimum((keys.astype(np.float64) * (buckets / 2.0**64)).astype(np.int64), buckets - 1)


def shared_buckets(a: np.ndarray, b: np.ndarray, buckets: int) -> Iterator[tuple[int, tuple[int, int], tuple[int, int]]]:
    """For each bucket that holds any of two arrays of ascending keys: its number and its range of each. Empty buckets cost nothing."""
    x, y = buckets_of(a, buckets), buckets_of(b, buckets)
    found = np.union1d(x, y)
    ends = np.searchsorted(x, found, "right"), np.searchsorted(y, found, "right")
    starts = np.searchsorted(x, found), np.searchsorted(y, found)
    yield from zip(found.tolist(), zip(starts[0].tolist(), ends[0].tolist()), zip(starts[1].tolist(), ends[1].tolist()))
