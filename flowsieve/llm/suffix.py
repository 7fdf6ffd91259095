"""Removal of repeated passages by a distributed, sparse suffix array.

A byte goes if a string of `length` bytes covers it that also starts earlier. Which suffixes must be sorted to find all of
these strings? Content decides: of every `length` bytes, the half-length grams with the smallest hash are anchors, so that
equal strings have an anchor at the same place. Anchors whose gram occurs once are dropped after an exchange of
hashes. What remains is sorted as suffixes from the anchor, with the bytes before it behind as a tail.

The sort is a merge sort. A task sorts its suffixes into runs by bucket of the gram's hash and front-codes them: each
keeps how many bytes it shares with the one before and the bytes that follow. A bucket's runs are merged by a loser tree that
compares two suffixes only from the prefix both are known to share with the last one put out, and leaves the longest common prefixes of neighbours.
For each offset of a string before its anchor, equal strings are then runs of neighbours that share
enough bytes to the right and the same bytes to the left; all but the earliest are repeated.

Skew: whole copies of a text never enter (one digest a document finds them); a task keeps only the earliest of equal suffixes;
and grams that a task sees HOT times, or that occur MANY times in all, go another way, by 64-bit digests of their windows, of which a task sends each once:
these spread evenly, where one gram would be one bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import cut, free, likely_ids, partitions_for, table, unlikely_ids, with_text_bytes, without_ids
from .kernels import Prefix, mix, pack_ints, pack_sorted, shared_buckets, slices, unpack_ints, unpack_sorted

#: A gram goes by digests if a task sees it so often before it sends, or if it occurs so often in all: alone it would fill a good part of a bucket, which
#: can't be cut below one gram.
HOT, MANY = 64, 4096
#: Anchors for a bucket of hashes, suffixes for a bucket of the sort, bytes of text or suffixes that a task gathers before it sends.
HASHES, SUFFIXES, TEXT, RUN = 300_000, 16_384, 12 << 20, 32_768
_U = np.uint64


def _sliding(v: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum, or maximum, of each w values in a row, by block prefixes and suffixes."""
    f = np.minimum if least else np.maximum
    n = len(v)
    blocks = -(-n // w) * w
    padded = np.full(blocks, np.iinfo(v.dtype).max if least else 0, v.dtype)
    padded[:n] = v
    shape = padded.reshape(-1, w)
    ahead = f.accumulate(shape, axis=1).ravel()
    behind = f.accumulate(shape[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, offs: np.ndarray, length: int, block: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors and hashes of their grams of length // 2 bytes.

    Whether a gram is an anchor depends on the `length` bytes on either side: a text of more than `block` bytes is looked at in overlapping parts."""
    k = length // 2
    w = length - k + 1
    n = len(data)
    if n > 2 * block:
        found, hashes = [], []
        for a in range(0, n, block):
            lo, hi = max(0, a - length), min(n, a + block + length)
            inner = np.unique(np.concatenate(([0], np.clip(offs - lo, 0, hi - lo), [hi - lo])))
            p, h = anchors(data[lo:hi], inner, length, n)
            mine = (p + lo >= a) & (p + lo < a + block)
            found.append(p[mine] + lo)
            hashes.append(h[mine])
        return np.concatenate(found), np.concatenate(hashes)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    at = np.arange(n - k + 1)
    h = Prefix(data).of(at, at + k)
    v = (h >> _U(32)).astype(np.uint32)
    low = _sliding(v, w, True)  # by start of string
    ends = np.repeat(offs[1:], np.diff(offs))
    low[np.arange(len(low)) + length > ends[: len(low)]] = 0  # not inside one document
    spread = np.zeros(len(v) + w - 1, np.uint32)
    spread[w - 1 : w - 1 + len(low)] = low
    best = _sliding(spread, w, False)  # over the strings that hold the gram
    found = np.flatnonzero((best == v) & (best > 0))
    return found, mix(h[found])  # small hashes make anchors: mixed once more, they spread over all buckets again


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offs in slices(batch):
            sha = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offs[:-1], offs[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offs)), pa.array(sha, pa.binary())], ["doc_id", "n_bytes", "sha"])


_MARKS = "bucket int, keys binary, docs binary, at binary, hot binary, doc_id long"


def _rows(names: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _send(length: int, buckets: int, most: int):
    """Anchor hashes with their places, by bucket; places of grams that are hot in this task, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, places, held = [], [], [], 0

        def flush():
            key, doc, at = np.concatenate(keys), np.concatenate(docs), np.concatenate(places)
            order = np.argsort(key, kind="stable")
            key, doc, at = key[order], doc[order], at[order]
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            counts = np.diff(np.append(heads, len(key)))
            hot = np.repeat(counts >= most, counts)
            hot_keys = key[heads][counts >= most]
            rows = []
            by = np.lexsort((at[hot], doc[hot]))
            d, a = doc[hot][by], at[hot][by]
            cuts = np.flatnonzero(d[1:] != d[:-1]) + 1
            for x, y in zip(np.split(d, cuts), np.split(a, cuts)):
                if len(x):
                    rows.append((int(x[0]) % buckets, None, None, pack_ints(y.astype(np.uint32)), None, int(x[0])))
            key, doc, at = key[~hot], doc[~hot], at[~hot]
            for b, (lo, hi), (x, y) in shared_buckets(key, hot_keys, buckets):
                rows.append((b, pack_sorted(key[lo:hi]), pack_ints(doc[lo:hi]), pack_ints(at[lo:hi].astype(np.uint32)), pack_sorted(hot_keys[x:y]), None))
            for i in range(0, len(rows), 256):
                yield _rows(_MARKS, rows[i : i + 256])

        for batch in batches:
            for part, data, offs in slices(batch, limit=1 << 20):
                found, h = anchors(data, offs, length)
                doc = np.searchsorted(offs, found, "right") - 1
                keys.append(h)
                docs.append(part.column(0).to_numpy(zero_copy_only=False)[doc])
                places.append(found - offs[doc])
                held += len(data)
                if held >= TEXT:
                    yield from flush()
                    keys, docs, places, held = [], [], [], 0
        if keys and sum(map(len, keys)):
            yield from flush()

    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places whose gram occurs twice or more: doc_id, and position * 2 + whether it is hot."""
    at, held = None, []

    def done():
        key, hot = np.concatenate([unpack_sorted(x[0]) for x in held]), np.concatenate([unpack_sorted(x[3]) for x in held])
        doc, place = np.concatenate([unpack_ints(x[1], np.int64) for x in held]), np.concatenate([unpack_ints(x[2], np.uint32) for x in held]).astype(np.int64)
        hot = np.unique(hot)
        order = np.argsort(key)
        key, doc, place = key[order], doc[order], place[order]
        same = key[1:] == key[:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        heads = np.flatnonzero(np.append(True, ~same)[: len(key)])
        counts = np.diff(np.append(heads, len(key)))
        is_hot = np.repeat(counts >= MANY, counts)
        if len(hot):
            near = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
            is_hot |= hot[near] == key
        keep = twice | is_hot
        doc, code = doc[keep], place[keep] * 2 + is_hot[keep]
        for i in range(0, len(doc), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(doc[i : i + 65536]), pa.array(code[i : i + 65536])], ["doc_id", "code"])

    for batch in batches:
        for bucket, k, d, a, x, doc in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if doc is not None:
                code = unpack_ints(a, np.uint32).astype(np.int64) * 2 + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), doc, np.int64)), pa.array(code)], ["doc_id", "code"])
                continue
            if bucket != at:
                if held:
                    yield from done()
                at, held = bucket, []
            held.append((k, d, a, x))
    if held:
        yield from done()


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(1)
    for batch in batches:
        for part, data, offs in slices(batch):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([press.compress(data[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:])], pa.binary())], ["doc_id", "z"])


#: kind 0: a front-coded run; 1: repeated bytes [start, end) of a document; 2: window digests.
_SENT = "kind int, bucket int, lcp binary, tail binary, docs binary, at binary, sides binary, doc_id long, start long, end long"


def front_code(rows: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Shared leading bytes with the row before, and what follows them, of sorted rows of one width."""
    width = len(rows[0])
    m = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, width)
    lcp = np.zeros(len(rows), np.uint8)
    differ = m[1:] != m[:-1]
    lcp[1:] = np.where(differ.any(1), differ.argmax(1), width)
    return lcp, m[np.arange(width) >= lcp[:, None]].tobytes()


def front_decode(lcp: np.ndarray, tail: bytes, width: int) -> list[bytes]:
    out, last, at = [], b"", 0
    for n in lcp.tolist():
        last = last[:n] + tail[at : at + width - n]
        at += width - n
        out.append(last)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Loser tree over sorted runs of (rows, shared bytes with the row before).

    Gives (run, row) in order, and the bytes that each shares with the one before. Every head in the tree carries how many
    bytes it shares with the last row put out on its path; of two heads the one that shares more comes first, and only at a draw are
    bytes compared, from there on."""
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    known = [0] * k
    row = [0] * k
    size = max((len(r[0][0]) for r in runs if r[0]), default=0)
    losers = [0] * k

    def beats(a: int, b: int) -> int:
        """The winner of two runs; the loser's known prefix becomes what it shares with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a
        if x is None:
            return b
        p, q = known[a], known[b]
        if p != q:
            return a if p > q else b
        d = int.from_bytes(x[p:], "big") ^ int.from_bytes(y[p:], "big")
        h = size - (d.bit_length() + 7) // 8
        if not d or x[h] < y[h]:
            known[b] = h
            return a
        known[a] = h
        return b

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        won = beats(a, b)
        losers[node] = b if won == a else a
        return won

    top = build(1) if k > 1 else 0
    order: list[tuple[int, int]] = []
    shared: list[int] = []
    while heads[top] is not None:
        order.append((top, row[top]))
        shared.append(known[top])
        row[top] += 1
        rows, lcps = runs[top]
        if row[top] < len(rows):
            heads[top], known[top] = rows[row[top]], lcps[row[top]]
        else:
            heads[top] = None
        won, node = top, (top + k) // 2
        while node >= 1:
            if beats(won, losers[node]) != won:
                won, losers[node] = losers[node], won
            node //= 2
        top = won
    return order, shared


def _order_keys(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rank of each (document, position); equal ones share a rank."""
    order = np.lexsort((at, doc))
    new = np.append(True, (doc[order][1:] != doc[order][:-1]) | (at[order][1:] != at[order][:-1]))[: len(doc)]
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _later(key: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """True where an equal key has a smaller rank."""
    order = np.lexsort((rank, key))
    k, r = key[order], rank[order]
    heads = np.append(True, k[1:] != k[:-1])[: len(k)]
    first = r[np.flatnonzero(heads)[np.cumsum(heads) - 1]] if len(k) else r
    out = np.zeros(len(k), bool)
    out[order] = r > first
    return out


def _contexts(length: int, buckets: int):
    """Suffixes at the marked anchors of each document, as sorted runs by bucket; windows of hot anchors as digests."""
    left = length - length // 2
    gram, width = length // 2, length + left
    weights = np.random.default_rng(99).integers(0, 1 << 63, gram, dtype=_U) * _U(2) + _U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, unpress = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()
        held: list[tuple] = []
        wins: list[tuple] = []
        n_held = n_wins = 0

        def flush():
            m, doc, at, lo, hi = (np.concatenate([h[i] for h in held]) for i in range(5))
            bucket = np.zeros(len(m), _U)
            for i in range(gram):
                bucket += m[:, i] * weights[i]
            bucket = (bucket >> _U(16)) % _U(buckets)
            rank = _order_keys(doc, at)
            rows = m.tobytes()
            keys = [rows[i * width : i * width + width] for i in range(len(m))]
            bucket, sides = bucket.tolist(), list(zip(lo.tolist(), hi.tolist()))
            order = sorted(range(len(m)), key=list(zip(bucket, keys, sides, rank.tolist())).__getitem__)
            out, group, last = [], [], None
            spans = []

            def emit(b, group):
                lcp, tail = front_code([keys[i] for i in group])
                g = np.array(group)
                out.append((0, b, press.compress(lcp.tobytes()), press.compress(tail), pack_ints(doc[g]), pack_ints(at[g].astype(np.uint32)), pack_ints(np.stack((lo[g], hi[g]), 1).astype(np.uint8).ravel()), None, None, None))

            for i in order:
                if group and bucket[group[-1]] != bucket[i]:
                    emit(bucket[group[-1]], group)
                    group, last = [], None
                if last is not None and keys[last] == keys[i] and sides[last] == sides[i]:
                    if rank[i] > rank[last] and lo[i] <= hi[i]:  # an equal suffix comes earlier: all of its strings are repeated
                        spans.append((1, bucket[i], None, None, None, None, None, int(doc[i]), int(at[i] - hi[i]), int(at[i] - lo[i] + length)))
                    continue
                group.append(i)
                last = i
            if group:
                emit(bucket[group[-1]], group)
            for rows in (out, spans):
                for i in range(0, len(rows), 1024):
                    yield _rows(_SENT, rows[i : i + 1024])

        def flush_windows():
            key, doc, at = (np.concatenate([w[i] for w in wins]) for i in range(3))
            rank = _order_keys(doc, at)
            later = _later(key, rank)
            spans = [(1, int(d) % buckets, None, None, None, None, None, int(d), int(a), int(b)) for d, a, b in _spans(doc[later], at[later], at[later] + length)]
            for i in range(0, len(spans), 1024):
                yield _rows(_SENT, spans[i : i + 1024])
            key, doc, at = key[~later], doc[~later], at[~later]
            order = np.argsort(key)
            key, doc, at = key[order], doc[order], at[order]
            rows = [(2, b, pack_sorted(key[lo:hi]), None, pack_ints(doc[lo:hi]), pack_ints(at[lo:hi].astype(np.uint32)), None, None, None, None) for b, (lo, hi), _ in shared_buckets(key, key[:0], buckets)]
            for i in range(0, len(rows), 256):
                yield _rows(_SENT, rows[i : i + 256])

        for batch in batches:
            ids, blobs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            codes = batch.column(2)
            values, offs = np.asarray(codes.flatten()), np.asarray(codes.offsets)
            offs = offs - offs[0]
            for i, (doc, z) in enumerate(zip(ids, blobs)):
                data = np.frombuffer(unpress.decompress(z), np.uint8)
                code = np.unique(values[offs[i] : offs[i + 1]])
                hot, x = code % 2 == 1, code // 2
                n = len(data)
                if (~hot).any():
                    at = x[~hot]
                    padded = np.concatenate((np.zeros(left, np.uint8), data, np.zeros(length, np.uint8)))
                    for s in range(0, len(at), 8192):
                        a = at[s : s + 8192]
                        right = padded[left + a[:, None] + np.arange(length)]
                        before = padded[left + a[:, None] - 1 - np.arange(left)]
                        held.append((np.concatenate((right, before), 1), np.full(len(a), doc, np.int64), a, np.maximum(0, length - (n - a)), np.minimum(left, a)))
                        n_held += len(a)
                if hot.any():
                    starts = np.unique(x[hot][:, None] - np.arange(left + 1))
                    starts = starts[(starts >= 0) & (starts + length <= n)]
                    wins.append((Prefix(data).of(starts, starts + length), np.full(len(starts), doc, np.int64), starts))
                    n_wins += len(starts)
                if n_held >= RUN:
                    yield from flush()
                    held, n_held = [], 0
                if n_wins >= 8 * RUN:
                    yield from flush_windows()
                    wins, n_wins = [], 0
        if n_held:
            yield from flush()
        if n_wins:
            yield from flush_windows()

    return run


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple]:
    """Union of [start, end) by document."""
    order = np.lexsort((start, doc))
    at = None
    for d, s, e in zip(doc[order].tolist(), start[order].tolist(), end[order].tolist()):
        if at and at[0] == d and s <= at[2]:
            at = (d, at[1], max(e, at[2]))
        else:
            if at:
                yield at
            at = (d, s, e)
    if at:
        yield at


def repeated_strings(shared: np.ndarray, rows: np.ndarray, doc: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> Iterator[tuple]:
    """Spans of a merged bucket's repeated strings.

    shared: bytes in common with the row before; rows: length bytes from the anchor, then those before it; a string may start low to high bytes before the anchor."""
    left = length - length // 2
    rank = _order_keys(doc, at)
    behind = np.zeros(len(at), _U)
    found: list[tuple] = []
    for j in range(left + 1):
        if j:
            behind = behind * _U(0x9E3779B97F4A7C15) + (rows[:, length + j - 1].astype(_U) + _U(1)) * _U(0xBF58476D1CE4E5B9)
        run = np.cumsum(shared < length - j)
        ok = np.flatnonzero((low <= j) & (j <= high))
        hit = ok[_later(mix(mix(behind[ok]) + run[ok].astype(_U) * _U(0xD6E8FEB86659FD93)), rank[ok])]
        if len(hit):
            found.append((doc[hit], at[hit] - j, at[hit] - j + length))
    if found:
        yield from _spans(*(np.concatenate([f[i] for f in found]) for i in range(3)))


def _merge(length: int):
    left = length - length // 2
    width = length + left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        at, runs, wins = None, [], []

        def out(spans):
            spans = list(spans)
            for i in range(0, len(spans), 65536):
                part = np.array(spans[i : i + 65536], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part[:, j]) for j in range(3)], ["doc_id", "start", "end"])

        def done():
            if runs:
                decoded = []
                for lcp, tail, *_ in runs:
                    lcp = np.frombuffer(unpress.decompress(lcp), np.uint8)
                    decoded.append((front_decode(lcp, unpress.decompress(tail), width), lcp.tolist()))
                order, shared = merge_runs(decoded)
                first = np.cumsum([0] + [len(d[0]) for d in decoded])
                index = np.array([first[r] + i for r, i in order])
                rows = np.frombuffer(b"".join(decoded[r][0][i] for r, i in order), np.uint8).reshape(-1, width)
                doc = np.concatenate([unpack_ints(r[2], np.int64) for r in runs])[index]
                place = np.concatenate([unpack_ints(r[3], np.uint32) for r in runs]).astype(np.int64)[index]
                sides = np.concatenate([unpack_ints(r[4], np.uint8) for r in runs]).reshape(-1, 2).astype(np.int64)[index]
                yield from out(repeated_strings(np.array(shared), rows, doc, place, sides[:, 0], sides[:, 1], length))
            if wins:
                key = np.concatenate([unpack_sorted(w[0]) for w in wins])
                doc = np.concatenate([unpack_ints(w[1], np.int64) for w in wins])
                place = np.concatenate([unpack_ints(w[2], np.uint32) for w in wins]).astype(np.int64)
                later = _later(key, _order_keys(doc, place))
                yield from out(_spans(doc[later], place[later], place[later] + length))

        for batch in batches:
            for kind, bucket, lcp, tail, docs, places, sides, doc, start, end in zip(*(batch.column(i).to_pylist() for i in range(10))):
                if kind == 1:
                    yield from out([(doc, start, end)])
                    continue
                if bucket != at:
                    yield from done()
                    at, runs, wins = bucket, [], []
                if kind == 0:
                    runs.append((lcp, tail, docs, places, sides))
                else:
                    wins.append((lcp, docs, places))
        yield from done()

    return run


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of spans to their union, and its bytes."""
    for batch in batches:
        lists = batch.column(1).to_pylist()
        merged = [[(s, e) for _, s, e in _spans(np.zeros(len(x), np.int64), np.array([p["start"] for p in x]), np.array([p["end"] for p in x]))] for x in lists]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[{"start": s, "end": e} for s, e in x] for x in merged], kind)], ["doc_id", "spans"])


def _meta(docs: DataFrame) -> DataFrame:
    return cut(with_text_bytes(docs).mapInArrow(_measure, "doc_id long, n_bytes long, sha binary"))


def _copies(meta: DataFrame, length: int) -> DataFrame:
    """Documents of `length` bytes or more whose text an earlier document has whole. Texts that occur once take no part in the join, and what stands on
    either side of it is written, so that Spark may split the rows of a text that is very common."""
    long = meta.where((F.col("n_bytes") >= length) & F.col("doc_id").isNotNull())
    firsts = cut(long.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(F.col("sha").alias("same"), "first"))
    return cut(long.join(firsts, F.col("sha") == F.col("same")).where("doc_id > first").select("doc_id", "n_bytes").distinct())


def repeated_spans(docs: DataFrame, length: int = 100, meta: DataFrame | None = None, hot: int = HOT) -> DataFrame:
    """(doc_id, spans): the bytes [start, end) of each document that a repeated string of `length` bytes covers.

    docs: doc_id and text; other columns are ignored. A string is repeated if it also starts earlier: in a document with a
    smaller doc_id, or before in the same one. Texts are UTF-8 bytes, null is empty; matches never cross documents.
    Spans are apart and ascending; documents without any don't appear. Rows with a null doc_id take no part. Rows that share
    a doc_id count as one document at the same positions, and share spans. Texts of any length are taken whole. An empty table gives no rows."""
    if not 4 <= length <= 160:
        raise ValueError("length must be from 4 to 160 bytes")
    meta = meta if meta is not None else _meta(docs)
    copies = _copies(meta, length)
    total = meta.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    texts = without_ids(with_text_bytes(docs).where("doc_id is not null"), copies.select("doc_id"))

    buckets = partitions_for(2 * total // (length - length // 2 + 2), HASHES)
    sent = texts.mapInArrow(_send(length, buckets, hot), _MARKS).repartition("bucket").sortWithinPartitions("bucket")
    marks = cut(sent.mapInArrow(_repeats, "doc_id long, code long").groupBy("doc_id").agg(F.collect_list("code").alias("codes")))
    n = marks.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()[0]

    buckets = partitions_for(n, SUFFIXES)
    marked = likely_ids(texts, marks.select("doc_id")).mapInArrow(_compress, "doc_id long, z binary").join(marks, "doc_id").select("doc_id", "z", "codes")
    runs = marked.mapInArrow(_contexts(length, buckets), _SENT).repartition("bucket").sortWithinPartitions("bucket", "kind")
    spans = runs.mapInArrow(_merge(length), "doc_id long, start long, end long").groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    whole = copies.select("doc_id", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))).alias("spans"))
    return cut(spans.mapInArrow(_union, "doc_id long, spans array<struct<start:long,end:long>>").unionByName(whole))


def kept_bytes(text: bytes, spans: list[dict]) -> bytes:
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["start"]])
        at = s["end"]
    return b"".join((*out, text[at:]))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        sha = [hashlib.sha256(kept_bytes(unpress.decompress(z), spans)).digest() for z, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha, pa.binary())], ["doc_id", "sha"])


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the spans' bytes cut out of text; a character that loses some of its bytes goes whole.

    Texts that may have spans travel compressed to the join with them; the others stay where they are."""
    names = docs.columns
    at = names.index("text")
    pressed = StructType([StructField(f.name, BinaryType() if i == at else f.dataType) for i, f in enumerate(docs.schema)])

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(1)
        for batch in batches:
            text = pa.array([None if t is None else z.compress(t.encode()) for t in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], text, *batch.columns[at + 1 :]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            text = [None if t is None else kept_bytes(z.decompress(t), s or []).decode("utf-8", "ignore") for t, s in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(text, pa.string()), *batch.columns[at + 1 : len(names)]], names)

    other, cuts = free(docs, "id", "spans")
    named = spans.select(F.col("doc_id").alias(other), F.col("spans").alias(cuts))
    likely = likely_ids(docs, spans.select("doc_id")).mapInArrow(press, pressed)
    joined = likely.join(named.hint("merge"), F.col("doc_id") == F.col(other), "left").drop(other)
    return unlikely_ids(docs, spans.select("doc_id")).unionByName(joined.mapInArrow(run, docs.schema))


def deduplicate(docs: DataFrame, length: int = 100, hot: int = HOT) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes left)."""
    meta = _meta(docs)
    spans = repeated_spans(docs, length, meta, hot)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    counts = spans.select("doc_id", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"))
    some = spans.join(meta.select("doc_id", "n_bytes").distinct(), "doc_id").where(removed < F.col("n_bytes")).select("doc_id", "spans")
    blobs = likely_ids(with_text_bytes(docs), some.select("doc_id")).mapInArrow(_compress, "doc_id long, z binary")
    left = blobs.join(some, "doc_id").select("doc_id", "z", "spans").mapInArrow(_digest, "doc_id long, sha binary").withColumnRenamed("sha", "left").dropDuplicates(["doc_id"])
    rows = meta.join(counts, "doc_id", "left").join(left, "doc_id", "left")
    sha = F.when(F.col("n_removed") == F.col("n_bytes"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.lower(F.hex(F.coalesce("left", "sha"))))
    return rows.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.when(F.col("n_removed").isNull(), F.lower(F.hex("sha"))).otherwise(sha).alias("kept_sha256"))


def op5_suffix_merge_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"), 100)
