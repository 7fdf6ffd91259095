"""Edge tables from files and tables: one schema (src, dst, weight, and seq or time_bin where there are any)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def clean_weight(value: Column) -> Column:
    """A number from any column: what isn't one is 0, and so is NaN."""
    return F.coalesce(F.nanvl(value.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def normalise(df: DataFrame, value_column: str = "bytes", keep: tuple[str, ...] = ("seq", "time_bin")) -> DataFrame:
    """(src, dst, weight, ...) of rows with both labels and a positive weight. Without the value column `packets` stands in, without that 1."""
    missing = [c for c in ("src", "dst") if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    name = value_column if value_column in df.columns else "packets" if "packets" in df.columns else None
    if name is None:
        weight, ok = F.lit(1.0), F.lit(True)
    elif df.schema[name].dataType.typeName() in ("long", "integer", "short", "byte"):
        weight, ok = F.col(name).cast("long"), F.col(name) > 0  # as it is: the filter reaches the scan
    else:
        weight = clean_weight(F.col(name))
        ok = weight > 0
    return df.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & ok).select("src", "dst", weight.alias("weight"), *(c for c in keep if c in df.columns))


def read_edges(spark: SparkSession, path: str, value_column: str = "bytes", schema: str | None = None) -> DataFrame:
    """Edges of a Parquet (.parquet, .pq) or CSV file or folder; without a schema, CSV columns are strings and numbers are parsed as needed."""
    if path.rstrip("/").endswith((".parquet", ".pq")):
        df = spark.read.parquet(path)
    else:
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema else reader).csv(path)
    return normalise(df, value_column)


def matrix_market_head(spark: SparkSession, path: str) -> tuple[str, str]:
    """Banner and size line of a Matrix Market file, or of the first part of a folder of them: read from its start, by the driver, a few lines."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    files = sorted((f.getPath() for f in fs.listStatus(where) if f.isFile() and f.getLen() and not f.getPath().getName().startswith(("_", "."))), key=lambda f: f.getName())
    if not files:
        raise ValueError(f"nothing to read at {path}")
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(files[0])
    stream = fs.open(files[0])
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
    try:
        banner = reader.readLine()
        if banner is None or not banner.startswith("%%MatrixMarket"):
            raise ValueError("not a Matrix Market file in coordinate format")
        while (line := reader.readLine()) is not None:
            if not line.startswith("%") and line.strip():
                return banner, line
    finally:
        reader.close()
    raise ValueError("no size line")


def read_matrix_market(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """(src, dst, weight) with labels from 0, repeats summed, and the numbers of rows and columns of the size line. Coordinate format; pattern cells weigh 1."""
    banner, size = matrix_market_head(spark, path)
    kind = banner.lower().split()
    if "coordinate" not in kind:
        raise ValueError("not a Matrix Market file in coordinate format")
    rows, cols = (int(x) for x in size.split()[:2])
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    # One line goes that reads as the size line does. A cell may read the same: all but one of these are cells.
    alike = lines.where(F.col("value") == size).agg(F.count("*").alias("n")).where("n > 1")
    alike = alike.select(F.explode(F.sequence(F.lit(2), F.col("n"))).alias("i")).select(F.lit(size).alias("value"))
    p = lines.where(F.col("value") != size).unionByName(alike).select(F.split(F.trim("value"), r"\s+").alias("p"))
    weight = F.coalesce(F.get("p", F.lit(2)).try_cast("double"), F.lit(1.0))
    out = p.select((F.col("p")[0].cast("long") - 1).alias("src"), (F.col("p")[1].cast("long") - 1).alias("dst"), weight.alias("weight"))
    if kind[-1] in ("symmetric", "skew-symmetric", "hermitian"):  # such files hold one half
        mirrored = out.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") * (-1 if kind[-1].startswith("skew") else 1)).alias("weight"))
        out = out.unionByName(mirrored)
    return out.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), rows, cols


def adapt_flows(flows: DataFrame, order: list, src: str = "SrcAddr", dst: str = "DstAddr", value: str = "TotBytes") -> DataFrame:
    """Flow records as edges (seq, src, dst, weight): addresses become codes in order of first appearance, each side by itself, a null address -1; flows without bytes go.

    First appearances are minima by label; codes are ranks of these, so that nothing is collected."""
    from ..operators.ordering import with_sequence

    rows = with_sequence(flows, order).select("seq", F.col(src).alias("s"), F.col(dst).alias("d"), clean_weight(F.col(value)).alias("weight"))
    out = rows
    for side, name in (("s", "src"), ("d", "dst")):
        firsts = rows.where(F.col(side).isNotNull()).groupBy(F.col(side).alias(f"{side}_l")).agg(F.min("seq").alias("at"))
        codes = with_sequence(firsts, ["at"], name=f"{name}_code").select(f"{side}_l", f"{name}_code")
        out = out.join(codes, F.col(side) == F.col(f"{side}_l"), "left").withColumn(name, F.coalesce(f"{name}_code", F.lit(-1))).drop(f"{side}_l", f"{name}_code")
    return out.where("weight > 0").select("seq", "src", "dst", "weight")
