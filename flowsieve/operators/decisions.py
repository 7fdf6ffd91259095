"""From an early prefix to a decision: features, recommended build, and whether a sketch's top k is safe."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import entropy_bits, gini_total, share
from .ordering import durable
from .pairs import aggregate_pairs
from .windows import gap_share, kth_weights, prefix

#: Fixed thresholds of the recommendation.
CONCENTRATED = {"duplication_rate": 0.55, "edge_gini": 0.82, "top_edge_share": 0.01, "top_vertex_share": 0.05}
DIFFUSE = {"duplication_rate": 0.20, "nnz_growth_rate": 0.80}
#: Fixed names of its answers.
PREAGGREGATE, DIRECT = "pandas_groupby", "sparse_direct"
ADVICE = {"concentrated": "viable_for_concentrated_heavy_hitters", "diffuse": "not_recommended_for_topk_without_large_candidates", "mixed": "profile_before_using_for_topk"}


def early_features(edges: DataFrame, prefix_edges: int = 50_000) -> DataFrame:
    """One row of 13 features of the first prefix_edges records; zeros for an empty prefix."""
    if prefix_edges <= 0:
        raise ValueError("prefix_edges must be positive")
    if "weight" not in edges.columns:
        raise ValueError("missing value column 'weight'")
    head = prefix(edges, prefix_edges)
    pairs = durable(head.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")))
    cells = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("observed_edges"), F.count("*").alias("unique_pairs"), F.coalesce(F.sum("weight"), F.lit(0)).cast("double").alias("w"), F.max("weight").alias("top_e"), entropy_bits("weight").alias("edge_entropy_bits"))
    side = lambda a, p, q: pairs.groupBy(a).agg(F.sum("weight").alias("s")).agg(F.count("*").alias(f"unique_{q}"), F.max("s").alias(f"top_{a}"), entropy_bits("s").alias(f"{p}_entropy_bits"))
    one = cells.join(F.broadcast(side("src", "source", "sources"))).join(F.broadcast(side("dst", "destination", "destinations"))).join(F.broadcast(gini_total(pairs, "weight", rows=pairs.count())))
    n = F.col("observed_edges")
    rate = F.when(n > 0, F.col("unique_pairs") / n).otherwise(0.0)
    return one.select(
        "observed_edges", "unique_pairs", "unique_sources", "unique_destinations",
        F.when(n > 0, 1 - rate).otherwise(0.0).alias("duplication_rate"), rate.alias("nnz_growth_rate"), "source_entropy_bits", "destination_entropy_bits", "edge_entropy_bits", F.col("gini").alias("edge_gini"),
        share(F.col("top_e"), F.col("w")).alias("top_edge_share"), share(F.col("top_src"), F.col("w")).alias("top_source_share"), share(F.col("top_dst"), F.col("w")).alias("top_destination_share"),
    )


def shape() -> Column:
    """concentrated, diffuse or mixed, of a row of features; concentrated wins."""
    at_least = lambda c, v: F.col(c) >= F.lit(v)
    concentrated = at_least("duplication_rate", CONCENTRATED["duplication_rate"]) | at_least("edge_gini", CONCENTRATED["edge_gini"]) | at_least("top_edge_share", CONCENTRATED["top_edge_share"]) | (F.greatest("top_source_share", "top_destination_share") >= CONCENTRATED["top_vertex_share"])
    diffuse = (F.col("duplication_rate") <= DIFFUSE["duplication_rate"]) & at_least("nnz_growth_rate", DIFFUSE["nnz_growth_rate"])
    return F.when(concentrated, "concentrated").when(diffuse, "diffuse").otherwise("mixed")


def recommend(features: DataFrame) -> DataFrame:
    """features with shape, recommended_exact_method and streaming_heavy_hitter_advice."""
    out = features.withColumn("shape", shape())
    advice = F.when(F.col("shape") == "concentrated", ADVICE["concentrated"]).when(F.col("shape") == "diffuse", ADVICE["diffuse"]).otherwise(ADVICE["mixed"])
    return out.withColumn("recommended_exact_method", F.when(F.col("shape") == "concentrated", PREAGGREGATE).otherwise(DIRECT)).withColumn("streaming_heavy_hitter_advice", advice)


def prefix_certificate(edges: DataFrame, prefix_edges: int = 50_000, k: int = 20, width: int = 8192, depth: int = 5, capacity: int = 512, on_exact_k: str = "kth", strict: bool = False) -> DataFrame:
    """One row: top-k share, gap, the least capacity and width that they ask for, margin and decision.

    strict: a tracker of c counters surely keeps weights above W / c; the default asks for W / (c + 1)."""
    pairs = durable(aggregate_pairs(prefix(edges, prefix_edges)))
    total = pairs.agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("double").alias("w"))
    row = total.join(F.broadcast(kth_weights(pairs, k))).withColumn("gap", gap_share(F.col("kth"), F.col("next"), F.col("w"), on_exact_k))
    inf = F.lit(float("inf"))
    need = F.ceil(F.col("w") / F.col("kth")) - (0 if strict else 1)
    noise = 2.0 * (math.e / width + 1.0 / (capacity + (0 if strict else 1)))
    row = row.select(
        F.lit(k).alias("top_k"),
        share(F.coalesce("topk", F.lit(0.0)), F.col("w")).alias("topk_weight_share"),
        share(F.coalesce("kth", F.lit(0.0)), F.col("w")).alias("kth_weight_share"),
        F.col("gap").alias("topk_gap_share"),
        F.when(F.col("kth") > 0, F.greatest(need, F.lit(0)).cast("double")).otherwise(inf).alias("c_min"),
        (F.col("gap") / 2).alias("epsilon_required"),
        F.when(F.col("gap") > 0, F.ceil(F.lit(math.e) / (F.col("gap") / 2)).cast("double")).otherwise(inf).alias("width_min"),
        (F.col("gap") - noise).alias("margin"),
        F.lit(width * depth * 8).cast("long").alias("sketch_bytes"),
    )
    why = (
        F.when(F.col("topk_weight_share") <= 0, "no weight in the top k")
        .when(F.col("topk_gap_share") <= 0, "no gap after rank k")
        .when(F.col("c_min") > capacity, "capacity too small")
        .when(F.col("width_min") > width, "width too small")
        .when(F.col("margin") <= 0, "joint error too large")
        .otherwise("ok")
    )
    return row.withColumn("reason", why).withColumn("decision", F.when(F.col("reason") == "ok", "certified_safe").otherwise("not_certified"))


def window_stability(edges: DataFrame, window_edges: int, prefix_edges: int, k: int = 20) -> DataFrame:
    """A row for each full window: features of its own prefix, shape and method, gap over all of it (0 with exactly k pairs), and whether all windows agree."""
    from pyspark.sql import Window

    from ..functions.stats import gini
    from .windows import window_statistics, windowed

    rows = windowed(edges, window_edges).where(F.col("seq") - F.col("window") * window_edges < prefix_edges)
    pairs = durable(rows.groupBy("window", "src", "dst").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")))
    cells = pairs.groupBy("window").agg(F.sum("n").alias("observed_edges"), F.count("*").alias("unique_pairs"), F.sum("weight").cast("double").alias("w"), F.max("weight").alias("top_e"))
    side = lambda a: pairs.groupBy("window", a).agg(F.sum("weight").alias("s")).groupBy("window").agg(F.max("s").alias(f"top_{a}"))
    one = cells.join(side("src"), "window").join(side("dst"), "window").join(gini(pairs, "weight", ["window"], rows=pairs.count()).withColumnRenamed("gini", "edge_gini"), "window")
    rate = F.col("unique_pairs") / F.col("observed_edges")
    one = one.select("window", "observed_edges", "unique_pairs", (1 - rate).alias("duplication_rate"), rate.alias("nnz_growth_rate"), "edge_gini", share(F.col("top_e"), F.col("w")).alias("top_edge_share"), share(F.col("top_src"), F.col("w")).alias("top_source_share"), share(F.col("top_dst"), F.col("w")).alias("top_destination_share"))
    gaps = window_statistics(edges, window_edges, k, on_exact_k="zero").select("window", "topk_gap_share")
    out = recommend(one).join(gaps, "window")
    every = Window.partitionBy(F.lit(0))  # a row for each window of the stream
    return out.withColumn("all_agree", F.min("recommended_exact_method").over(every) == F.max("recommended_exact_method").over(every))
