"""Edge tables from the benchmark tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ordering import with_sequence


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def diffuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to part, price in cents."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), cents("l_extendedprice").alias("weight"))


def diffuse_sequenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(*ORDER, cents("l_extendedprice").alias("weight"))
    return with_sequence(rows, ORDER).select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), "weight", "seq")


def tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to part, quantity: few distinct weights, many ties."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").cast("long").alias("weight"))


def skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price in cents; of the first two lines of an order by the logarithms of supplier and part, which makes a few heavy pairs, of the others as in diffuse."""
    few = F.col("l_linenumber") <= 2
    side = lambda c: F.when(few, -F.floor(F.ln(F.col(c).cast("double") + 1))).otherwise(F.col(c)).cast("long")
    return table(spark, sf_dir, "lineitem").select(side("l_suppkey").alias("src"), side("l_partkey").alias("dst"), cents("l_extendedprice").alias("weight"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nation to supplier nation, price in cents: lines are summed by order and supplier before the joins widen them."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", cents("l_extendedprice").alias("weight"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    by_nation = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).select("l_orderkey", "dst", "weight")
    return by_nation.join(orders, by_nation.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey")).select("src", "dst", "weight")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User to event type, value in cents; event_id is a dense position, the day of ts a bin."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.col("event_type").alias("dst"), cents("value").alias("weight"), F.col("event_id").alias("seq"), F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).alias("time_bin"))


SQL = {
    "a": "SELECT l_suppkey AS src, l_partkey AS dst, CAST(round(l_extendedprice * 100) AS BIGINT) AS weight FROM lineitem",
    "aseq": "SELECT l_suppkey AS src, l_partkey AS dst, CAST(round(l_extendedprice * 100) AS BIGINT) AS weight, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS seq FROM lineitem",
    "b": "SELECT l_suppkey AS src, l_partkey AS dst, CAST(l_quantity AS BIGINT) AS weight FROM lineitem",
    "skew": "SELECT CASE WHEN l_linenumber <= 2 THEN -CAST(floor(ln(l_suppkey + 1)) AS BIGINT) ELSE l_suppkey END AS src, CASE WHEN l_linenumber <= 2 THEN -CAST(floor(ln(l_partkey + 1)) AS BIGINT) ELSE l_partkey END AS dst, CAST(round(l_extendedprice * 100) AS BIGINT) AS weight FROM lineitem",
    "c": "SELECT c_nationkey AS src, s_nationkey AS dst, CAST(round(l_extendedprice * 100) AS BIGINT) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey",
    "d": "SELECT user_id AS src, event_type AS dst, CAST(round(value * 100) AS BIGINT) AS weight, event_id AS seq, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS time_bin FROM events",
}
