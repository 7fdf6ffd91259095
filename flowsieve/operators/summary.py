"""Scalar summaries of a pair table: sizes, entropy, concentration, spectrum, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.stats import entropy_bits, gini_total
from .ordering import durable, with_sequence
from .pairs import strengths


def matrix_summary(pairs: DataFrame, singular: DataFrame | None = None) -> DataFrame:
    """One row of scalars. Dimensions are the labels seen. singular: one row with top_singular_value, see top_singular_value().

    The pairs are written once; labels, cells and the histogram of weights are read from there."""
    pairs = durable(pairs)
    src, dst = strengths(pairs, "src"), strengths(pairs, "dst")
    side = lambda s, p: s.agg(F.count("*").alias(f"n_{p}"), F.coalesce(F.max("strength"), F.lit(0)).cast("double").alias(f"max_{p}_strength"), F.coalesce(F.max("degree"), F.lit(0)).alias(f"max_{p}_degree"), entropy_bits("strength").alias(f"{p}_entropy_bits"))
    cells = pairs.agg(F.count("*").alias("nnz"), F.coalesce(F.sum("weight"), F.lit(0)).cast("double").alias("total_weight"), F.coalesce(F.max("weight"), F.lit(0)).cast("double").alias("max_edge"))
    # Single rows, each an aggregate: joining them is no product of tables.
    out = cells.join(F.broadcast(side(src, "source"))).join(F.broadcast(side(dst, "destination"))).join(F.broadcast(gini_total(pairs, "weight", rows=pairs.count()).withColumnRenamed("gini", "edge_gini")))
    out = out.withColumn("density", F.col("nnz") / F.greatest(F.col("n_source") * F.col("n_destination"), F.lit(1)))
    return out.join(F.broadcast(singular)) if singular is not None else out


def frobenius_norm(pairs: DataFrame) -> DataFrame:
    w = F.col("weight").cast("double")
    return pairs.agg(F.sqrt(F.coalesce(F.sum(w * w), F.lit(0.0))).alias("frobenius_norm"))


def top_singular_value(pairs: DataFrame, rounds: int = 16, cut_every: int = 4) -> DataFrame:
    """One row: top_singular_value by `rounds` power iterations on A'A from the even vector, an estimate from below.

    A round is two products of the pair table with a vector, each a join and a sum by label; the lineage is cut every few rounds."""
    cells = durable(pairs.select("src", "dst", F.col("weight").cast("double").alias("w")))
    x = cells.select("dst").distinct().withColumn("x", F.lit(1.0))
    norm = x.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    x = x.join(F.broadcast(norm)).select("dst", (F.col("x") / F.col("n")).alias("x"))
    value = None
    for i in range(rounds):
        y = cells.join(x, "dst").groupBy("src").agg(F.sum(F.col("w") * F.col("x")).alias("y"))
        z = cells.join(y, "src").groupBy("dst").agg(F.sum(F.col("w") * F.col("y")).alias("z"))
        value = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("top_singular_value"))
        norm = z.agg(F.sqrt(F.sum(F.col("z") * F.col("z"))).alias("n"))
        x = z.join(F.broadcast(norm)).select("dst", F.when(F.col("n") > 0, F.col("z") / F.col("n")).otherwise(0.0).alias("x"))
        if i % cut_every == cut_every - 1:
            x = durable(x)
    return value.select(F.coalesce("top_singular_value", F.lit(0.0)).alias("top_singular_value"))


#: Labels in a bitmap of Spark's; 64-bit words of one.
_LABELS, _WORDS = 32_768, 512


def similarity_cells(pairs: DataFrame, axis: str = "src") -> DataFrame:
    """One row: stored cells of the similarity of sources (or destinations) by shared neighbours, diagonal included.

    A neighbour of d labels makes d * d / 2 pairs. Where these are few, half of the symmetric product is enumerated: labels that share a neighbour meet in an
    equi-join on it, and pairs found by several neighbours fall together before the exchange. Where hubs would make too many, each neighbour's labels are
    bitmaps, and a label's similar ones are the union of its neighbours' bitmaps, whose bits are counted: d bitmaps instead of d * d pairs. Both count exactly."""
    other = "dst" if axis == "src" else "src"
    cells = durable(pairs.select(F.col(axis).alias("a"), F.col(other).alias("via")).distinct())
    degree = cells.groupBy("via").agg(F.count("*").cast("double").alias("d"))
    blocks = F.least(F.col("d"), F.ceil(F.col("labels") / _LABELS))
    cost = degree.join(F.broadcast(cells.agg(F.count_distinct("a").alias("labels")))).agg(F.sum(F.col("d") * (F.col("d") - 1) / 2).alias("pairs"), F.sum(F.col("d") * blocks * _WORDS / 8).alias("maps")).first()
    if (cost["pairs"] or 0) <= (cost["maps"] or 0):
        half = cells.join(cells.select(F.col("a").alias("b"), "via"), "via").where("a < b").groupBy("a", "b").agg(F.lit(1).alias("one"))
        count = half.agg(F.count("*").alias("h")).join(F.broadcast(cells.agg(F.count_distinct("a").alias("d")))).select((2 * F.col("h") + F.col("d")).alias("n"))
    else:
        codes = with_sequence(cells.select("a").distinct(), ["a"], name="code").select(F.col("a").alias("label"), "code")
        coded = durable(cells.join(codes, F.col("a") == F.col("label")).select("code", "via"))
        maps = coded.groupBy(F.col("via").alias("of"), F.expr(f"code div {_LABELS}").alias("block")).agg(F.bitmap_construct_agg(F.col("code") % _LABELS).alias("bits"))
        unions = coded.join(maps, F.col("via") == F.col("of")).groupBy("code", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
        count = unions.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))
    return count.select(F.col("n").cast("long").alias(f"{axis}_similarity_nnz"))


def official_formula(pairs: DataFrame) -> DataFrame:
    """One row: total weight, activity cells, and the cells of both similarities."""
    pairs = durable(pairs)
    head = pairs.agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("double").alias("total_weight"), F.count("*").alias("activity_nnz"), F.count_distinct("src").alias("n_source"), F.count_distinct("dst").alias("n_destination"))
    return head.join(F.broadcast(similarity_cells(pairs, "src"))).join(F.broadcast(similarity_cells(pairs, "dst")))


def trace_statistics(edges: DataFrame) -> DataFrame:
    """One row of what a provenance manifest records: records, distinct labels and pairs, least, largest and total weight."""
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("n"), F.min("weight").alias("lo"), F.max("weight").alias("hi"), F.sum("weight").alias("w"))
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count_distinct("src").alias("unique_sources"), F.count_distinct("dst").alias("unique_destinations"), F.count("*").alias("unique_pairs"), F.min("lo").alias("min_weight"), F.max("hi").alias("max_weight"), F.coalesce(F.sum("w"), F.lit(0)).alias("total_weight")
    )


def mean_and_std(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def fastest(rows: DataFrame, by: list[str], method: str = "method", seconds: str = "seconds") -> DataFrame:
    """The method with the least seconds in each group; ties by name."""
    best = F.min(F.struct(F.col(seconds).alias("s"), F.col(method).alias("m")))
    return rows.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.m").alias(method), F.col("b.s").alias(seconds))


