"""Structured Streaming jobs over edge files: event-time bins, and sketches merged batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import sketches


def edge_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format("parquet")
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(folder)


def windowed_totals(stream: DataFrame, ts: str = "ts", width: str = "1 day", late: str = "1 hour", keys: tuple[str, ...] = ()) -> DataFrame:
    """window_start, keys, records, weight by tumbling event-time window; records later than the watermark allows are dropped. A timestamp without zone is taken as the
    session's."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    out = timed.groupBy(F.window("__ts", width).alias("w"), *keys).agg(F.count("*").alias("records"), F.sum("weight").alias("weight"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "records", "weight")


class SketchState:
    """Count-Min counters and vertex strengths of a stream, as tables of deltas under root.

    Each batch writes its own sums, named by the batch, and nothing else: a replayed batch overwrites them, so that it counts once. Every `fold` batches the sums
    so far become a base, and what lies behind the base before it is removed: a batch costs its own keys, a read one base and `fold` deltas at most."""

    SCHEMAS = {"sketch": "row int, col long, w double", "src": "label string, s double, n long", "dst": "label string, s double, n long"}
    KEYS = {"sketch": ("row", "col"), "src": ("label",), "dst": ("label",)}

    def __init__(self, spark: SparkSession, root: str, width: int = sketches.WIDTH, depth: int = sketches.DEPTH, fold: int = 16):
        self.spark, self.root, self.width, self.depth, self.fold = spark, root.rstrip("/"), width, depth, fold
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, table: str, kind: str) -> list[int]:
        where = self._path(f"{self.root}/{table}/{kind}")
        if not self._fs.exists(where):
            return []
        found = (f.getPath() for f in self._fs.listStatus(where))
        return sorted(int(p.getName()) for p in found if self._fs.exists(self._path(p, "_SUCCESS")))

    def _write(self, df: DataFrame, table: str, kind: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/{kind}/{batch:012d}")

    def _sums(self, table: str, batch: int) -> DataFrame:
        """Sums over all batches up to `batch`: the newest base not beyond it, and the deltas since."""
        base = max((b for b in self._numbers(table, "base") if b <= batch), default=-1)
        paths = [f"{self.root}/{table}/delta/{b:012d}" for b in self._numbers(table, "delta") if base < b <= batch]
        paths += [f"{self.root}/{table}/base/{base:012d}"] if base >= 0 else []
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMAS[table])
        rows = self.spark.read.schema(self.SCHEMAS[table]).parquet(*paths)
        values = [c for c in rows.columns if c not in self.KEYS[table]]
        return rows.groupBy(*self.KEYS[table]).agg(*(F.sum(c).alias(c) for c in values))

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        sketch = sketches.count_min(batch, self.width, self.depth).select("row", "col", F.col("w").cast("double").alias("w"))
        self._write(sketch.coalesce(1), "sketch", "delta", batch_id)
        for side in ("src", "dst"):
            now = batch.groupBy(F.col(side).cast("string").alias("label")).agg(F.sum("weight").cast("double").alias("s"), F.count("*").alias("n"))
            self._write(now, side, "delta", batch_id)
        batch.unpersist()
        if batch_id % self.fold == self.fold - 1:
            for table in self.SCHEMAS:
                before = max((b for b in self._numbers(table, "base") if b < batch_id), default=-1)
                self._write(self._sums(table, batch_id), table, "base", batch_id)
                for kind in ("delta", "base"):
                    for b in self._numbers(table, kind):
                        if b < before or (b == before and kind == "delta"):  # the last base stays, for readers and for a replay
                            self._fs.delete(self._path(f"{self.root}/{table}/{kind}/{b:012d}"), True)

    def sketch(self, batch_id: int) -> DataFrame:
        return self._sums("sketch", batch_id)

    def strengths(self, batch_id: int, side: str) -> DataFrame:
        return self._sums(side, batch_id)

    def run(self, stream: DataFrame, checkpoint: str) -> int:
        """Runs the stream over what is there now; gives the last batch's number."""
        query = stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query.lastProgress["batchId"] if query.lastProgress else -1


def collect_stream(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None, after: Callable | None = None) -> DataFrame:
    """Runs a streaming aggregate over what is there now into a table in memory: for small results only."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    if after:
        after(query)
    return stream.sparkSession.table(name)
