"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a temporary one; on a cluster
    that is an error, since a machine's own folder is not seen by the others."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="flowsieve-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


#: Bytes of a batch between the JVM and Python: what a task holds of texts at once, on both sides.
BATCH, _BATCH = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's limit of a batch to BATCH bytes where it is larger: rows alone don't bound a batch of long texts."""
    limit = spark.conf.get(_BATCH, None)
    number = "".join(c for c in limit or "" if c.isdigit())
    if limit and not (limit.rstrip("b").isdigit() and 0 < int(number) <= BATCH):
        spark.conf.set(_BATCH, str(BATCH))


_written: list[list[str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there, and a lost executor costs a reread."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/flowsieve/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _written:
        _written[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def consumed(spark: SparkSession) -> Iterator[None]:
    """Removes what cut() wrote inside the block. For blocks whose results are written elsewhere before it ends."""
    _written.append([])
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for name in _written.pop():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, whatever case: each with underscores in front, as many as it takes."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions_for(n: int, per: int, least: int = 1) -> int:
    return max(least, math.ceil(n / per))


def with_text_bytes(docs: DataFrame) -> DataFrame:
    """Only what the text operators read, so that other columns may have any name and type."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


#: Bits of the filter for each id; its least and largest size. What is broadcast is 16 MB at most.
BITS_PER_ID, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 27
_ROW_BITS = 32768


def _hit(df: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, Column, str] | None:
    """df with a filter's bits joined, a condition that is false only where the row's id is surely not among ids, and the joined column's name.

    The ids go into a bitmap with BITS_PER_ID bits an id, MOST_BITS at most; that is what is broadcast. None where a bitmap of that size would be
    half full: then all rows should take part in the exact join."""
    n = ids.count()
    if 2 * n > MOST_BITS:
        return None
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (n * BITS_PER_ID).bit_length()))
    name = ids.columns[0]
    slot = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(bits))
    row, held = free(df, "row", "held")
    slots = ids.select(slot(F.col(name)).alias("s")).select((F.col("s") / _ROW_BITS).cast("int").alias(row), (F.col("s") % _ROW_BITS).alias("p"))
    rows = slots.groupBy(row).agg(F.bitmap_construct_agg("p").alias(held))
    at = slot(F.col(id_col))
    byte = F.conv(F.hex(F.substring(F.col(held), ((at % _ROW_BITS) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    joined = df.join(F.broadcast(rows), (at / _ROW_BITS).cast("int") == F.col(row), "left").drop(row)
    return joined, found, held


def likely_ids(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose id is among ids, and a few others: a join on the id must follow."""
    marked = _hit(df, ids, id_col)
    return marked[0].where(marked[1]).drop(marked[2]) if marked else df


def unlikely_ids(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that likely_ids() leaves out."""
    marked = _hit(df, ids, id_col)
    return marked[0].where(~marked[1]).drop(marked[2]) if marked else df.limit(0)


def without_ids(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """df less the rows with these ids. Only rows that the bitmap can't clear are exchanged."""
    (other,) = free(df, "id")
    exact = ids.select(F.col(ids.columns[0]).alias(other)).distinct()
    doubtful = likely_ids(df, ids, id_col).join(exact, F.col(id_col) == F.col(other), "left_anti")
    return unlikely_ids(df, ids, id_col).unionByName(doubtful)
