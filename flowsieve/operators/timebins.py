"""Summaries by time bin and a robust anomaly score over bins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.stats import entropy_bits, gini, share
from .ordering import durable

#: Fixed: the columns with a robust z, and those whose positive z the score sums (all but the Gini).
Z_COLUMNS = ("total_weight", "nnz", "source_entropy_bits", "destination_entropy_bits", "edge_gini", "top_edge_share", "top_source_share", "top_destination_share", "unique_sources", "unique_destinations")
SCORED = tuple(c for c in Z_COLUMNS if c != "edge_gini")


def time_bin_summary(edges: DataFrame) -> DataFrame:
    """A row for each time_bin. One exchange on (bin, pair) carries the counts; the pairs are written once, and sources, destinations and the Gini follow from them."""
    pairs = durable(edges.groupBy("time_bin", "src", "dst").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")))
    whole = pairs.groupBy("time_bin").agg(F.sum("n").alias("n_edges"), F.count("*").alias("nnz"), F.sum("weight").cast("double").alias("total_weight"), F.max("weight").cast("double").alias("top"))

    def side(axis: str, name: str, plural: str) -> DataFrame:
        s = pairs.groupBy("time_bin", axis).agg(F.sum("weight").alias("s"))
        return s.groupBy("time_bin").agg(entropy_bits("s").alias(f"{name}_entropy_bits"), F.max("s").cast("double").alias(f"top_{name}"), F.count("*").alias(f"unique_{plural}"))

    out = whole.join(side("src", "source", "sources"), "time_bin").join(side("dst", "destination", "destinations"), "time_bin").join(gini(pairs, "weight", ["time_bin"], rows=pairs.count()), "time_bin")
    total = F.col("total_weight")
    return out.select(
        "time_bin", "n_edges", "nnz", "total_weight", "source_entropy_bits", "destination_entropy_bits", F.col("gini").alias("edge_gini"),
        share(F.col("top"), total).alias("top_edge_share"), share(F.col("top_source"), total).alias("top_source_share"), share(F.col("top_destination"), total).alias("top_destination_share"),
        "unique_sources", "unique_destinations",
    )


def anomaly_scores(summary: DataFrame) -> DataFrame:
    """summary with <column>_robust_z and anomaly_score. z: distance from the median in median absolute deviations (unscaled), or in population standard
    deviations where that is 0, or in ones. Medians are single rows, broadcast."""
    centre = summary.agg(*(F.median(F.col(c).cast("double")).alias(f"m_{c}") for c in Z_COLUMNS), *(F.stddev_pop(c).alias(f"s_{c}") for c in Z_COLUMNS))
    rows = summary.join(F.broadcast(centre))
    mads = rows.agg(*(F.median(F.abs(F.col(c) - F.col(f"m_{c}"))).alias(f"d_{c}") for c in Z_COLUMNS))
    rows = rows.join(F.broadcast(mads))
    scale = lambda c: F.when(F.col(f"d_{c}") > 0, F.col(f"d_{c}")).when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0)
    z = rows.select(*summary.columns, *(((F.col(c) - F.col(f"m_{c}")) / scale(c)).alias(f"{c}_robust_z") for c in Z_COLUMNS))
    score = reduce(lambda a, b: a + b, (F.greatest(F.col(f"{c}_robust_z"), F.lit(0.0)) for c in SCORED))
    return z.withColumn("anomaly_score", score)


def injected_bins(summary: DataFrame, bad_bin: int, by: str = "scenario") -> DataFrame:
    """A row for each scenario of scored summaries: the injected bin's rank (highest score first), score and figures, beside the medians of weight and pairs
    over the other bins."""
    ranked = anomaly_ranks(summary, (by,)).withColumn("injected", F.col("time_bin") == bad_bin)
    typical = ranked.groupBy(by).agg(*(F.median(F.when(~F.col("injected"), F.col(c).cast("double"))).alias(f"typical_{c}_median") for c in ("total_weight", "nnz")))
    figures = ("total_weight", "nnz", "top_edge_share", "top_source_share", "top_destination_share", "unique_sources", "unique_destinations")
    own = ranked.where("injected").select(by, F.col("time_bin").alias("anomaly_bin"), F.col("rank").cast("long").alias("anomaly_rank"), "anomaly_score", *figures)
    return own.join(typical, by)


def anomaly_ranks(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """scored with rank, highest score first, ties to the earlier bin; by scenario if asked. Time bins are few."""
    order = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return scored.withColumn("rank", F.row_number().over(order.orderBy(F.desc("anomaly_score"), "time_bin")))


