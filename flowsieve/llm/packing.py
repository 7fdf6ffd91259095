"""Packing documents into token sequences by best-fit decreasing.

A document longer than a sequence is first cut into full windows; what is left of it is one piece. Pieces are
dealt into groups of about GROUP rows by a hash of (doc_id, start) and of their place, so that no document, source or crowd of equal rows makes a large group. Each group is packed by
itself, longest piece first, into the tightest open window, found in a segment tree indexed by remaining
capacity. Only lengths are exchanged; the ids stay where the text was read, unless asked for.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, partitions_for, table, with_text_bytes
from .encoding import REMEMBERED, encoder, forget
from .kernels import slices

GROUP = 2048


def _pieces(path: str, window: int, end: int, keep_ids: bool, remembered: int, lasting: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path, remembered)
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            for part, data, offs in slices(batch):
                flat, bounds = made.encode(data, offs)
                totals = np.diff(bounds) + 1
                counts = -(-totals // window)
                doc = np.repeat(np.arange(len(totals)), counts)
                starts = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * window
                lengths = np.minimum(totals[doc] - starts, window)
                ids = memoryview(flat.astype("<u4").tobytes())
                begin = bounds[:-1][doc] + starts
                closes = starts + lengths == totals[doc]
                pieces = [bytes(ids[4 * a : 4 * (a + n - c)]) + last * c for a, n, c in zip(begin.tolist(), lengths.tolist(), closes.tolist())]
                out = [part.column(0).take(pa.array(doc)), pa.array(starts), pa.array(lengths), pa.array([zlib.crc32(x) for x in pieces], pa.int64()), pa.array(totals[doc])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    out, names = [*out, pa.array(pieces, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)
        if not lasting:
            del made
            forget()

    return run


class Capacities:
    """Open windows by what they can still take: a segment tree of counts over capacities."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        i = capacity + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Takes out the window with the least capacity of at least `length`: (capacity, window)."""
        count, i = self.count, length + self.size
        if not count[i]:
            while i > 1 and not (i % 2 == 0 and count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; pieces come longest first."""
    free, at, offsets, used = Capacities(window), [], [], 0
    for n in lengths:
        found = free.tightest(n)
        if found is None:
            found, used = (window, used), used + 1
        capacity, w = found
        at.append(w)
        offsets.append(window - capacity)
        if capacity > n:
            free.add(capacity - n, w)
    return at, offsets


def _pack(window: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done():
            rows = pa.Table.from_batches(held).combine_chunks()
            at, offsets = best_fit(rows.column("length").to_pylist(), window)
            group = rows.column("part")[0].as_py()
            rows = rows.append_column("sequence_id", pa.array([w * groups + group for w in at], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
            yield from rows.drop_columns(["part"]).to_batches(max_chunksize=8192)

        for batch in batches:
            part = batch.column(0).to_numpy()
            ends = [*(i + 1 for i in range(len(part) - 1) if part[i] != part[i + 1]), len(part)]
            begin = 0
            for end in ends:
                if end > begin:
                    if held and held[0].column(0)[0].as_py() != part[begin]:
                        yield from done()
                        held = []
                    held.append(batch.slice(begin, end - begin))
                begin = end
        if held:
            yield from done()

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end: int = 1, keep_ids: bool = False, group: int = GROUP, remembered: int = REMEMBERED, lasting: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with keep_ids also ids.

    docs: doc_id and text; other columns are ignored. A document is its token ids and then `end`; a null or empty
    text is `end` alone. Each id lies in exactly one piece, each piece in one sequence of at most `window` ids, and the pieces of a sequence
    follow each other from offset 0. Repeated rows are packed each; a null doc_id stays null. A text of any length is taken
    whole. An empty table gives no rows. remembered: pieces of text that a worker keeps the ids of; lasting: beyond its task. ids: the piece's ids as little-endian unsigned 32-bit integers."""
    names = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    pieces = cut(with_text_bytes(docs).mapInArrow(_pieces(tokenizer, window, end, keep_ids, remembered, lasting), names))
    groups = partitions_for(pieces.count(), group)
    # The place of a row in what was written tells equal rows apart, so that thousands of them don't make one group.
    dealt = pieces.select(F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)).alias("part"), "*")
    dealt = dealt.repartition("part").sortWithinPartitions("part", F.desc("length"), "doc_id", "start", "ids_crc32")
    return dealt.mapInArrow(_pack(window, groups), names + ", sequence_id long, offset long")


def sequences(pieces: DataFrame, window: int = 2048, pad: int = 0) -> DataFrame:
    """The token sequences of pack(keep_ids=True): sequence_id, ids (array of `window` ids, padded with `pad`), used."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for parts in batch.column(1).to_pylist():
                row = array("I", b"".join(p["ids"] for p in parts)).tolist()
                ids.append(row + [pad] * (window - len(row)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), batch.column(2)], ["sequence_id", "ids", "used"])

    parts = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("used"))
    return parts.mapInArrow(build, "sequence_id long, ids array<int>, used long")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
