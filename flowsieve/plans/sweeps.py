"""Experiments over edge tables: parameter sweeps and drivers, a row for each setting or source. Defaults are fixed, as the experiments are defined by them."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import conformal, decisions, pairs as P, pricing, sketches, summary, timebins, windows
from ..operators.ordering import durable
from ..sources import edges as E, sinks, synthetic

#: Fixed: the builders that are timed, by the names of the recommendation.
BUILDERS = {"sparse_direct": "direct", "pandas_groupby": "preaggregate"}


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _accuracy(edges: DataFrame, width: int, depth: int, capacity: int, k: int) -> DataFrame:
    pairs = durable(P.aggregate_pairs(edges))
    exact = P.top_k_edges(pairs, k)
    candidates = sketches.space_saving(edges, capacity)
    summary, ranked = sketches.stream_summary(edges, candidates, sketches.count_min(pairs, width, depth), width, depth)
    out = sketches.streaming_accuracy(exact, ranked, k).join(F.broadcast(summary))
    return out.withColumn("width", F.lit(width)).withColumn("depth", F.lit(depth)).withColumn("capacity", F.lit(capacity))


def width_sweep(edges: DataFrame, widths: tuple[int, ...] = (512, 2048, 8192, 32768), depth: int = 5, capacity: int = 512, k: int = 20) -> DataFrame:
    """Accuracy and totals of the sketch path by Count-Min width."""
    return _union([_accuracy(edges, w, depth, capacity, k) for w in widths])


def capacity_sweep(edges: DataFrame, capacities: tuple[int, ...] = (64, 128, 512, 2048, 8192), width: int = 8192, depth: int = 5, k: int = 20) -> DataFrame:
    """Accuracy and totals of the sketch path by tracker capacity."""
    return _union([_accuracy(edges, width, depth, c, k) for c in capacities])


def dyadic_comparison(edges: DataFrame, k: int = 20, width: int = 8192, depth: int = 4, beam: int = 4096, capacity: int = 512) -> DataFrame:
    """One row: both decoders under both definitions of recall."""
    pairs = durable(P.aggregate_pairs(edges))
    exact = P.top_k_edges(pairs, k)
    keys, bits, dst_bits = sketches.edge_keys(pairs)
    found = sketches.unpack(sketches.dyadic_heavy_hitters(sketches.dyadic_count_min(keys, bits, width, depth), bits, k, beam, width, depth), dst_bits)
    dyadic = sketches.streaming_accuracy(exact, found, k).select(F.col("topk_recall").alias("dyadic_topk_recall"))
    _, ranked = sketches.stream_summary(edges, sketches.space_saving(edges, capacity), sketches.count_min(pairs, width, depth), width, depth)
    tracker = sketches.streaming_accuracy(exact, ranked, k).select(F.col("topk_recall").alias("tracker_topk_recall"), F.col("candidate_recall").alias("tracker_candidate_recall"))
    size = (bits - min(12, bits) + 1) * width * depth * 8
    return dyadic.join(F.broadcast(tracker)).withColumn("dyadic_bytes", F.lit(size).cast("long"))


def phase_points(edges: DataFrame, widths: tuple[int, ...] = (512, 2048, 8192, 32768), capacities: tuple[int, ...] = (64, 512, 8192), k: int = 20) -> DataFrame:
    """gap, budget, identifiability index and measured recall of each (width, capacity)."""
    pairs = durable(P.aggregate_pairs(edges))
    total = pairs.agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("double").alias("w"))
    gap = total.join(F.broadcast(windows.kth_weights(pairs, k))).select(windows.gap_share(F.col("kth"), F.col("next"), F.col("w"), "zero").alias("gap"))
    rows = _union([_accuracy(edges, w, 5, c, k) for w in widths for c in capacities]).select("width", "capacity", "candidate_recall", "topk_recall")
    return rows.join(F.broadcast(gap)).withColumn("index", pricing.identifiability_index(F.col("gap"), F.col("width"), F.col("capacity")))


def certify(edges: DataFrame, source: str, window_edges: int = 50_000, k: int = 20, alphas: tuple[float, ...] = (0.05, 0.1, 0.2), budgets: tuple[tuple[int, int], ...] = ((8192, 512), (16384, 5000))) -> dict[str, DataFrame]:
    """Window scores to certificates (first half of the windows), coverage, adaptive bounds and prices."""
    scores = durable(windows.window_statistics(edges, window_edges, k).select(F.lit(source).alias("source"), "window", F.col("topk_gap_share").alias("score")))
    half = scores.join(F.broadcast(scores.agg(F.floor(F.count("*") / 2).alias("h")))).where("window < h").drop("h")
    frame = scores.sparkSession.createDataFrame([*budgets], "width int, capacity int")
    certificates = conformal.certificates(half, frame, alphas)
    prices = pricing.price(conformal.lower_bounds(half, alphas).withColumnRenamed("bound", "gap"))
    return {"scores": scores, "certificates": certificates, "coverage": conformal.coverage(scores, alphas), "adaptive": conformal.adaptive(scores), "prices": prices}


def select_and_certify(edges: DataFrame, prefix_edges: int = 50_000, k: int = 20, width: int = 8192, depth: int = 5, capacity: int = 512) -> DataFrame:
    """One row: early features, recommended build and the prefix certificate."""
    head = decisions.recommend(decisions.early_features(edges, prefix_edges))
    return head.join(F.broadcast(decisions.prefix_certificate(edges, prefix_edges, k, width, depth, capacity)))


def identifiable_recall(sources: dict[str, DataFrame], k: int = 20, width: int = 8192, depth: int = 5, capacity: int = 512) -> DataFrame:
    """A row for each source: source, n_edges and the identifiability report of the sketch path's ranking."""
    rows = []
    for name, edges in sources.items():
        edges = durable(edges)
        _, ranked = sketches.stream_summary(edges, sketches.space_saving(edges, capacity), sketches.count_min(edges, width, depth), width, depth)
        report = sketches.identifiability_report(edges, ranked, k, width, capacity)
        rows.append(edges.agg(F.lit(name).alias("source"), F.count("*").alias("n_edges")).join(F.broadcast(report)))
    return _union(rows)


def priced_recall(sources: dict[str, DataFrame], prices: DataFrame, k: int = 20, depth: int = 5) -> DataFrame:
    """A row for each source with a feasible price (source, feasible, width, capacity, total_bytes): what recall the priced memory gives."""
    rows = []
    for price in prices.where(F.col("source").isin(*sources) & F.col("feasible")).collect():  # one for each named source
        edges = durable(sources[price["source"]])
        found = _accuracy(edges, price["width"], depth, price["capacity"], k).select("topk_recall", "candidate_recall", "median_relative_error")
        head = edges.agg(F.lit(price["source"]).alias("source"), F.count("*").alias("n_edges"), *(F.lit(price[c]).cast("long").alias(c) for c in ("width", "capacity", "total_bytes")))
        rows.append(head.join(F.broadcast(found)))
    return _union(rows) if rows else prices.sparkSession.createDataFrame([], "source string, n_edges long, width long, capacity long, total_bytes long, topk_recall double, candidate_recall double, median_relative_error double")


def _timed(build: Callable[[], DataFrame], repeats: int) -> list[float]:
    out = []
    for _ in range(repeats):
        began = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        out.append(time.perf_counter() - began)
    return out


def router(sources: dict[str, DataFrame], bounds: DataFrame, prefix_edges: int = 50_000, memory_budget: int = 64_000_000, repeats: int = 3, native: tuple[str, ...] = ()) -> DataFrame:
    """A row for each source: both builders are timed on its prefix, its bound (source, bound) is looked up, and the router decides."""
    rows = []
    for name, edges in sources.items():
        head = durable(windows.prefix(edges, prefix_edges))
        seconds = {m: min(_timed(lambda s=s: P.aggregate_pairs(head, strategy=s), repeats)) for m, s in BUILDERS.items()}
        heuristic = decisions.recommend(decisions.early_features(head, prefix_edges)).first()["recommended_exact_method"]
        rows.append((name, seconds["sparse_direct"], seconds["pandas_groupby"], heuristic, name in native))
    profiles = bounds.sparkSession.createDataFrame(rows, "source string, sparse_seconds double, pandas_seconds double, heuristic string, native boolean")
    return pricing.route(pricing.with_bounds(profiles, bounds), memory_budget)


def format_smoke(pairs: DataFrame, path: str) -> DataFrame:
    """Two rows, the pair table and what comes back of it from a Matrix Market file at `path`: sizes, weight, and whether they are the same matrix."""
    pairs = durable(pairs)
    sinks.write_matrix_market(path, pairs)
    back, n_rows, n_cols = E.read_matrix_market(pairs.sparkSession, path)
    back = durable(back)
    same = P.compare(P.coded_pairs(pairs).select(F.col("row").alias("src"), F.col("col").alias("dst"), "weight"), back).select("equivalent")
    names = ("n_source", "n_destination", "nnz", "density", "total_weight")
    first = summary.matrix_summary(pairs).select(F.lit("edge_table").alias("check"), *names, F.lit(True).alias("matches"))
    sizes = (F.col("n_source") == n_rows) & (F.col("n_destination") == n_cols)
    second = summary.matrix_summary(back).join(F.broadcast(same)).select(F.lit("matrix_market").alias("check"), *names, (F.col("equivalent") & sizes).alias("matches"))
    return first.unionByName(second)


def formula_comparison(pairs: DataFrame) -> DataFrame:
    """Two rows: the summary by one pass over the pair table, and by the formulas taken literally, with the similarity cells, which only these count (0 elsewhere); and seconds."""
    pairs = durable(pairs)
    rows = []
    for name, make in (("summary", summary.matrix_summary), ("formulas", summary.official_formula)):
        began = time.perf_counter()
        one = durable(make(pairs))
        seconds = time.perf_counter() - began
        nnz = F.col("nnz" if name == "summary" else "activity_nnz")
        more = [F.col(c) if c in one.columns else F.lit(0).cast("long").alias(c) for c in ("src_similarity_nnz", "dst_similarity_nnz")]
        rows.append(one.select(F.lit(name).alias("implementation"), "n_source", "n_destination", nnz.alias("nnz"), "total_weight", (nnz / F.greatest(F.col("n_source") * F.col("n_destination"), F.lit(1))).alias("density"), *more, F.lit(seconds).alias("seconds")))
    return _union(rows)


def trace_experiment(edges: DataFrame, prefix_edges: int = 50_000, k: int = 20, width: int = 8192, depth: int = 5, capacities: tuple[int, ...] = (64, 512, 2048, 8192), repeats: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of one edge table with seq: exact builders with times and whether they agree; the selector's advice beside the measured winner; the capacity sweep."""
    edges = durable(edges)
    spark, n = edges.sparkSession, edges.count()
    whole = durable(P.aggregate_pairs(edges))
    times = {m: _timed(lambda s=s: P.aggregate_pairs(edges, strategy=s), repeats) for m, s in BUILDERS.items()}
    agree = {m: P.compare(whole, P.aggregate_pairs(edges, strategy=s)).first()["equivalent"] for m, s in BUILDERS.items()}
    rows = [(m, n, sum(t) / len(t), min(t), n / max(min(t), 1e-12), agree[m]) for m, t in times.items()]
    exact = spark.createDataFrame(rows, "method string, n_edges long, seconds_mean double, seconds_min double, edges_per_second double, matches boolean").join(F.broadcast(summary.matrix_summary(whole).select("nnz", "density", "total_weight", "edge_gini")))
    winner = min(times, key=lambda m: min(times[m]))
    advice = decisions.recommend(decisions.early_features(edges, prefix_edges)).withColumn("fastest_method", F.lit(winner))
    advice = advice.withColumn("recommendation_matches", F.col("recommended_exact_method") == F.col("fastest_method"))
    return exact, advice, capacity_sweep(edges, capacities, width, depth, k)


def anomaly_ranking(spark: SparkSession, scenarios: tuple[str, ...] = synthetic.SCENARIOS, n: int = 120_000, labels: int = 4096, bins: int = 24, bad_bin: int = 17, seed: int = 59) -> tuple[DataFrame, DataFrame]:
    """Scored bins of every scenario, and a row for each: where the injected bin ranks, its figures, and the medians of the other bins."""
    scored = []
    for i, scenario in enumerate(scenarios):
        edges = E.normalise(synthetic.make_anomaly_edges(spark, scenario, n, labels, bins, bad_bin, seed + i))
        scored.append(timebins.anomaly_scores(timebins.time_bin_summary(edges)).withColumn("scenario", F.lit(scenario)))
    bins_ = durable(_union(scored))
    return bins_, timebins.injected_bins(bins_, bad_bin)


def benchmark(spark: SparkSession, sizes: tuple[int, ...] = (10_000, 100_000), regimes: tuple[str, ...] = synthetic.REGIMES, repeats: int = 3, seed: int = 7) -> dict[str, DataFrame]:
    """Every way to build the pair table over generated regimes: `runs`, a row for each run with its seconds, sizes, whether its cells are the same as the direct ones' and the JVM's
    memory in use; their `means`; the `fastest` way of each regime and size."""
    rows = []
    jvm = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    for n in sizes:
        for regime in regimes:
            edges = durable(E.normalise(synthetic.make_edges(spark, n, *synthetic.shape(regime, n), regime, seed)))
            exact = durable(P.aggregate_pairs(edges))
            one = summary.matrix_summary(exact).first()
            for method in P.STRATEGIES:
                same = P.compare(exact, P.aggregate_pairs(edges, strategy=method)).first()["equivalent"]
                for i, seconds in enumerate(_timed(lambda m=method: P.aggregate_pairs(edges, strategy=m), repeats)):
                    used = (jvm.totalMemory() - jvm.freeMemory()) / 2**20
                    rows.append((regime, method, n, i, seconds, n / max(seconds, 1e-12), one["nnz"], one["density"], one["total_weight"], one["edge_gini"], same, used))
    runs = spark.createDataFrame(rows, "regime string, method string, n_edges long, run int, seconds double, edges_per_second double, nnz long, density double, total_weight double, edge_gini double, matches boolean, memory_mb double")
    means = summary.mean_and_std(runs, ["regime", "method", "n_edges"], "seconds")
    return {"runs": runs, "means": means, "fastest": summary.fastest(means, ["regime", "n_edges"], "method", "mean")}
