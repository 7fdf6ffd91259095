"""Prefixes and disjoint count-based windows of an edge stream that carries an explicit position `seq`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.stats import share
from .pairs import aggregate_pairs


def prefix(edges: DataFrame, n: int) -> DataFrame:
    """The first n records."""
    return edges.where(F.col("seq") < n)


def windowed(edges: DataFrame, window_edges: int) -> DataFrame:
    """edges with their window; a last window that isn't full is dropped."""
    if window_edges <= 0:
        raise ValueError("window_edges must be positive")
    total = edges.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("n")).withColumn("windows", F.expr(f"n div {window_edges}")).select("windows")
    return edges.withColumn("window", F.expr(f"seq div {window_edges}")).join(F.broadcast(total)).where("window < windows").drop("windows")


def kth_weights(pairs: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, kth, next: weights at ranks k and k + 1, null where there are fewer. Only k + 1 rows of a group pass each task."""
    keys = list(by)
    if keys:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("weight"), "src", "dst"))
        best = pairs.withColumn("r", rank).where(F.col("r") <= k + 1)
    else:
        best = pairs.orderBy(F.desc("weight"), "src", "dst").limit(k + 1)
        best = best.withColumn("r", F.row_number().over(Window.orderBy(F.desc("weight"), "src", "dst")))
    at = lambda r: F.max(F.when(F.col("r") == r, F.col("weight"))).cast("double")
    return best.groupBy(*keys).agg(at(k).alias("kth"), at(k + 1).alias("next"), F.sum(F.when(F.col("r") <= k, F.col("weight"))).cast("double").alias("topk"))


def gap_share(kth: Column, following: Column, total: Column, on_exact_k: str = "kth") -> Column:
    """(w_k - w_k+1) / W. With exactly k pairs there is no next one: 'kth' takes w_k / W, 'zero' takes 0. Fewer pairs: 0."""
    if on_exact_k not in ("kth", "zero"):
        raise ValueError("on_exact_k must be 'kth' or 'zero'")
    alone = kth if on_exact_k == "kth" else F.lit(0.0)
    return share(F.when(kth.isNull(), F.lit(0.0)).when(following.isNull(), alone).otherwise(F.greatest(kth - following, F.lit(0.0))), total)


def window_statistics(edges: DataFrame, window_edges: int, k: int = 20, on_exact_k: str = "kth") -> DataFrame:
    """A row for each full window: window, window_edges, unique_pairs, duplication_rate, total_weight, topk_gap_share, kth_weight_share."""
    pairs = aggregate_pairs(windowed(edges, window_edges), ("window",))
    totals = pairs.groupBy("window").agg(F.count("*").alias("unique_pairs"), F.sum("weight").cast("double").alias("total_weight"))
    out = totals.join(kth_weights(pairs, k, ("window",)), "window")
    return out.select(
        "window",
        F.lit(window_edges).cast("long").alias("window_edges"),
        "unique_pairs",
        (1 - F.col("unique_pairs") / F.lit(float(window_edges))).alias("duplication_rate"),
        "total_weight",
        gap_share(F.col("kth"), F.col("next"), F.col("total_weight"), on_exact_k).alias("topk_gap_share"),
        share(F.coalesce("kth", F.lit(0.0)), F.col("total_weight")).alias("kth_weight_share"),
    )
