"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Rows with equal texts form a group that is placed whole; only one with more bytes than a shard's even share is split, by a hash of doc_id, into the fewest
pieces that fit. Packing runs in levels. Cells of about CELL groups are packed by themselves into as many bins as there are shards, largest group
first, each where the dot product with the bin's residual capacity is highest. The bins of cells are the items of the next level, cell by cell again, until
there are few enough for the driver, which places them into the shards by the same rule. Bins of one level stay together in the next, so that
placing a row takes one join with a table of bins.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, partitions_for, table, with_text_bytes
from .kernels import Words, slices

#: Items of a cell; bins that the driver places.
CELL, ON_DRIVER = 2048, 32_768
#: Rows whose slots are counted off together.
SLOTS = 1024


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offs in slices(batch):
            texts = [data[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(np.diff(offs) + 1),
                    pa.array(Words(data, offs).counts.astype(np.int64)),
                    pa.array([zlib.crc32(t) for t in texts], pa.int64()),
                    pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary()),
                ],
                ["doc_id", "size", "tokens", "text_crc32", "digest"],
            )


def place(items: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each item (a row of loads), items in the order in which they are placed."""
    totals = np.maximum(items.sum(0), 1e-9)
    scaled = items / totals
    left = np.full((bins, items.shape[1]), 1.0 / bins)
    out = np.empty(len(items), np.int32)
    for i, item in enumerate(scaled):
        score = np.maximum(left, 0) @ item  # a bin that is full in one dimension still takes what it has room for in the others
        fits = (left >= item - 1e-12).all(1)
        out[i] = b = int(np.argmax(np.where(fits, score, score - 1e3) if fits.any() else score if score.any() else left.sum(1)))
        left[b] -= item
    return out


def _order(items: np.ndarray) -> np.ndarray:
    return np.argsort(-(items / np.maximum(items.sum(0), 1e-9)).max(1), kind="stable")


def _cells(bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done():
            rows = pa.Table.from_batches(held).combine_chunks()
            items = np.stack([rows.column(c).to_numpy().astype(float) for c in ("size", "tokens", "rows")], 1)
            order, at = _order(items), np.empty(len(items), np.int32)
            at[order] = place(items[order], bins)
            yield from rows.append_column("bin", pa.array(at)).to_batches(max_chunksize=8192)

        for batch in batches:
            cell = batch.column(0).to_numpy()
            begin = 0
            for end in [*(np.flatnonzero(cell[1:] != cell[:-1]) + 1), len(cell)]:
                if end > begin:
                    if held and held[0].column(0)[0].as_py() != cell[begin]:
                        yield from done()
                        held = []
                    held.append(batch.slice(begin, end - begin))
                begin = int(end)
        if held:
            yield from done()

    return run


_LOADS = ("size", "tokens", "rows")


def _packed(items: DataFrame, keys: list[str], n: int, shards: int, cell: int) -> DataFrame:
    """items (keys, loads) with cell and bin: dealt to cells by a hash of the keys, packed there."""
    kinds = ", ".join(f"{k} {t}" for k, t in items.select(*keys).dtypes)
    dealt = items.select(F.pmod(F.xxhash64(*keys), F.lit(partitions_for(n, cell))).cast("int").alias("cell"), *keys, *_LOADS)
    dealt = dealt.repartition("cell").sortWithinPartitions("cell", *keys)
    return cut(dealt.mapInArrow(_cells(shards), f"cell int, {kinds}, size long, tokens long, rows long, bin int"))


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in _LOADS))


def shard(docs: DataFrame, shards: int = 8, cell: int = CELL, on_driver: int = ON_DRIVER) -> DataFrame:
    """A row for each document: doc_id, size, tokens, text_crc32, shard, slot.

    docs: doc_id and text; other columns are ignored. size: UTF-8 bytes of the text plus 1, tokens: its
    words; a null text has none of either and counts as equal to an empty one. Rows with equal texts share a shard, unless
    their sizes together exceed the even share of one. slot counts a shard's rows from 0 without gaps. Repeated rows and null ids are rows
    like others; a text of any length is one row's. An empty table gives an empty table."""
    rows = cut(with_text_bytes(docs).mapInArrow(_measure, "doc_id long, size long, tokens long, text_crc32 long, digest binary"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count("*").alias("rows")).first()
    share = max(1.0, total["size"] / shards)

    sizes = rows.groupBy("digest").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    # Groups of several rows beyond a shard's even share: fewer than there are shards.
    hot = sizes.where("rows > 1").select("digest", F.ceil(F.col("size") / share).alias("pieces")).where("pieces > 1")
    rows = cut(rows.join(F.broadcast(hot), "digest", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("pieces")), F.lit(0))).drop("pieces"))

    items = rows.groupBy("digest", "piece").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    placed = _packed(items, ["digest", "piece"], total["rows"], shards, cell)
    bins, above = cut(_sums(placed, "cell", "bin")), []
    while (n := bins.count()) > on_driver:
        below = bins.select(F.col("cell").alias("of"), F.col("bin").alias("of_bin"), *_LOADS)
        above.append(_packed(below, ["of", "of_bin"], n, shards, max(cell, 2 * shards)))
        bins = cut(_sums(above[-1], "cell", "bin"))

    loads = bins.orderBy("cell", "bin").toPandas()
    vectors = loads[list(_LOADS)].to_numpy(float).reshape(-1, 3)
    order, at = _order(vectors), np.empty(len(vectors), np.int32)
    at[order] = place(vectors[order], shards)
    loads["shard"] = at
    where = docs.sparkSession.createDataFrame(list(loads[["cell", "bin", "shard", "rows"]].itertuples(index=False, name=None)), "cell int, bin int, shard int, rows long")
    small = not above
    while above:  # from the top down: a level's bins are where their parents are
        where = cut(above.pop().join(where.select("cell", "bin", "shard"), ["cell", "bin"]).select(F.col("of").alias("cell"), F.col("of_bin").alias("bin"), "shard", "rows"))
    where = where.select("cell", "bin", "shard", F.ceil(F.col("rows") / SLOTS).alias("parts"))
    where = F.broadcast(where) if small else where
    out = rows.join(placed.select("digest", "piece", "cell", "bin"), ["digest", "piece"]).join(where, ["cell", "bin"])
    # Slots: a bin's rows are counted off in parts of about SLOTS, so that neither a shard nor a large group meets in one task.
    out = cut(out.select("doc_id", "size", "tokens", "text_crc32", "shard", "cell", "bin", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part")))
    key = ["shard", "cell", "bin", "part"]
    counts = out.groupBy(*key).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell", "bin", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select(*key, before.alias("first"))
    within = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "text_crc32", "size"))
    numbered = out.withColumn("__i", within).join(firsts, key)
    return numbered.select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("first") + F.col("__i") - 1).alias("slot"))


def op8_vector_bin_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
