"""Where results go: CSV or Parquet folders, Matrix Market text, a provenance manifest."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ordering import durable, with_sequence
from ..operators.pairs import coded_pairs, strength_distribution, top_k_edges
from ..operators.summary import matrix_summary, trace_statistics


def save_analysis(prefix: str, pairs: DataFrame, k: int = 20, fmt: str = "csv") -> list[str]:
    """<prefix>_summary, _top_edges, _src_strength and _dst_strength as folders."""
    pairs = durable(pairs)
    frames = {"summary": matrix_summary(pairs), "top_edges": top_k_edges(pairs, k), "src_strength": strength_distribution(pairs, "src"), "dst_strength": strength_distribution(pairs, "dst")}
    for name, df in frames.items():
        writer = df.write.mode("overwrite")
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(f"{prefix}_{name}")
    return [f"{prefix}_{name}" for name in frames]


def write_matrix_market(path: str, pairs: DataFrame, labels: str | None = None) -> None:
    """A coordinate file, cells in row order, as one text part; with `labels`, also label tables <labels>_src and <labels>_dst, which the format itself loses."""
    cells = durable(coded_pairs(pairs))
    size = pairs.agg(F.count_distinct("src"), F.count_distinct("dst"), F.count("*")).first()
    spark = pairs.sparkSession
    head = spark.createDataFrame([(-2, 0, "%%MatrixMarket matrix coordinate real general"), (-1, 0, f"{size[0]} {size[1]} {size[2]}")], "row long, col long, value string")
    body = cells.select("row", "col", F.concat_ws(" ", (F.col("row") + 1).cast("string"), (F.col("col") + 1).cast("string"), F.col("weight").cast("string")).alias("value"))
    head.union(body).repartition(1).sortWithinPartitions("row", "col").select("value").write.mode("overwrite").text(path)
    if labels:
        for side in ("src", "dst"):
            with_sequence(pairs.select(side).distinct(), [side], name="code").write.mode("overwrite").parquet(f"{labels}_{side}")


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a whole file of any store, streamed on the driver's JVM."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def manifest(edges: DataFrame, source: str, head: bytes | None = None, path: str | None = None, **more) -> str:
    """JSON with the source, its trace statistics, and the SHA-256 of the file at `path`, or of the bytes given, where there are any."""
    stats = trace_statistics(edges).first().asDict()
    digest = file_digest(edges.sparkSession, path) if path else hashlib.sha256(head).hexdigest() if head is not None else None
    return json.dumps({"source": source, **stats, "sha256": digest, **more}, indent=2, sort_keys=True, default=str)


def write_pcap(path: str, packets: DataFrame) -> None:
    """One capture, microseconds, little endian, Ethernet: packets (seq, src, dst, weight[, payload]) in order of seq, weight as original length, payload more
    captured bytes. One task writes the file, as a capture is one stream; it comes into place when it is whole."""
    import struct

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n = path.removeprefix("file://").removeprefix("file:"), 0
        if "://" in name:
            store, name = fs.FileSystem.from_uri(name)
        else:
            store = fs.LocalFileSystem()
        with store.open_output_stream(f"{name}.partial") as out:
            out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 1 << 16, 1))
            for batch in batches:
                for seq, src, dst, weight, payload in zip(*(c.to_pylist() for c in batch.columns)):
                    body = b"\0" * 12 + b"\x08\0" + b"\x45" + b"\0" * 11 + struct.pack(">II", src, dst) + b"\0" * payload
                    out.write(struct.pack("<IIII", seq >> 20, seq & 0xFFFFF, len(body), weight) + body)
                n += batch.num_rows
        store.move(f"{name}.partial", name)
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["packets"])

    payload = F.col("payload").cast("long") if "payload" in packets.columns else F.lit(0).cast("long")
    rows = packets.select(*(F.col(c).cast("long").alias(c) for c in ("seq", "src", "dst", "weight")), payload.alias("payload"))
    rows.repartition(1).sortWithinPartitions("seq").mapInArrow(run, "packets long").collect()
