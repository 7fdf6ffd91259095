"""Dense positions in a total order, without a single sorting task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local master gets a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="flowsieve-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: what follows scans columns, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/flowsieve/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_sequence(df: DataFrame, order: list, count: str | None = None, name: str = "seq", partitions: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """df with the dense position of each row in the order, from 0; with count, the sum of that column over the rows before. by: positions inside each group.

    Rows are sorted in ranges, which may cut a group. The sizes of ranges give each its offset. Equal keys are ordered by
    chance: the order should be total."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    groups = [F.col(c) for c in by]
    ranged = df.repartitionByRange(partitions, *groups, *keys) if partitions else df.repartitionByRange(*groups, *keys)
    part = durable(ranged.withColumn("__part", F.spark_partition_id()))
    step = F.col(count) if count else F.lit(1).cast("long")
    heads = part.groupBy(*by, "__part").agg(F.sum(step).alias("__n"))
    earlier = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    inside = F.coalesce(F.sum(step).over(Window.partitionBy("__part", *by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if by:  # a row for each group and range it touches: as many as there are groups, so that Spark chooses the join
        heads = heads.select(F.col("__part").alias("__p"), *(F.col(c).alias(f"__g{i}") for i, c in enumerate(by)), "__first")
        on = F.col("__part") == F.col("__p")
        for i, c in enumerate(by):
            on = on & F.col(c).eqNullSafe(F.col(f"__g{i}"))
        joined = part.withColumn("__in", inside).join(heads, on).drop("__p", *(f"__g{i}" for i in range(len(by))))
    else:  # one row a partition: its size is bounded by the number of partitions
        joined = part.withColumn("__in", inside).join(F.broadcast(heads), "__part")
    return joined.withColumn(name, F.col("__first") + F.col("__in")).drop("__part", "__first", "__in")
