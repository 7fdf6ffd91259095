"""Distribution-free lower bounds on the gap of future windows, and what they certify."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def conformal_rank(alpha: float, m: int) -> int:
    """floor(alpha * (m + 1)) in binary doubles."""
    return math.floor(alpha * (m + 1))


def budget_threshold(width: Column | float, capacity: Column | float):
    """Error resolution of a sketch pair, 2 * (e / width + 1 / (capacity + 1)): plain numbers or columns."""
    return 2.0 * (math.e / width + 1.0 / (capacity + 1))


def lower_bounds(scores: DataFrame, alphas: tuple[float, ...], by: tuple[str, ...] = ("source",)) -> DataFrame:
    """by, alpha, m, rank, bound: the r-th smallest score, r = floor(alpha * (m + 1)); -inf with r = 0."""
    order = Window.partitionBy(*by)
    ranked = scores.select(*by, F.col("score").cast("double"), F.row_number().over(order.orderBy("score")).alias("r"), F.count("*").over(order).alias("m"))
    levels = ranked.withColumn("alpha", F.explode(F.array(*(F.lit(float(a)) for a in alphas)))).withColumn("rank", F.floor(F.col("alpha") * (F.col("m") + 1)))
    found = levels.groupBy(*by, "alpha").agg(F.first("m").alias("m"), F.first("rank").alias("rank"), F.max(F.when(F.col("r") == F.col("rank"), F.col("score"))).alias("b"))
    return found.select(*by, "alpha", "m", "rank", F.coalesce("b", F.lit(float("-inf"))).alias("bound"))


def certificates(scores: DataFrame, budgets: DataFrame, alphas: tuple[float, ...] = (0.1,), by: tuple[str, ...] = ("source",)) -> DataFrame:
    """Bounds of each source against each budget (width, capacity): certified if the bound is above the threshold. Budgets are a handful: each bound gets all of them
    as one list."""
    each = budgets.agg(F.collect_list(F.struct("width", "capacity")).alias("budgets"))
    out = lower_bounds(scores, alphas, by).join(F.broadcast(each)).withColumn("b", F.explode("budgets")).select("*", "b.*").drop("b", "budgets")
    out = out.withColumn("threshold", budget_threshold(F.col("width"), F.col("capacity")))
    return out.withColumn("certified", F.col("bound") > F.col("threshold")).withColumn("margin", F.col("bound") - F.col("threshold"))


def coverage(scores: DataFrame, alphas: tuple[float, ...] = (0.05, 0.1, 0.2), by: tuple[str, ...] = ("source",), calibration: int | None = None) -> DataFrame:
    """The first half of each source's windows (or `calibration` of them) bound the rest: by, alpha, n_calibration, n_test, rank, bound, coverage, valid.
    coverage and valid are null without a test window."""
    order = Window.partitionBy(*by)
    rows = scores.select(*by, F.col("score").cast("double"), F.row_number().over(order.orderBy("window")).alias("i"), F.count("*").over(order).alias("n"))
    half = F.floor(F.col("n") / 2) if calibration is None else F.least(F.lit(calibration), F.col("n"))
    rows = rows.withColumn("test", F.col("i") > half)
    bounds = lower_bounds(rows.where("not test"), alphas, by)
    tests = rows.where("test").select(*by, F.col("score").alias("s"))
    out = bounds.join(tests, list(by), "left").groupBy(*by, "alpha", F.col("m").alias("n_calibration"), "rank", "bound").agg(F.count("s").alias("n_test"), F.avg(F.when(F.col("s").isNotNull(), (F.col("s") >= F.col("bound")).cast("double"))).alias("coverage"))
    return out.withColumn("valid", F.col("coverage") >= 1.0 - F.col("alpha"))


#: Fixed: windows seen before the first bound; range that the level is held to when a rank is taken.
WARMUP, LEAST_LEVEL, MOST_LEVEL = 20, 1e-6, 0.999


def adaptive(scores: DataFrame, target: float = 0.1, gamma: float = 0.05, warmup: int = WARMUP) -> DataFrame:
    """Adaptive conformal inference: source, window, alpha_t, bound, score, miscovered. A fold over each source's windows, which are few."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        from bisect import insort

        rows = rows.sort_values("window")
        seen: list[float] = []
        alpha, out = target, []
        for i, (window, score) in enumerate(zip(rows["window"], rows["score"])):
            if i >= warmup:
                rank = math.floor(min(max(alpha, LEAST_LEVEL), MOST_LEVEL) * (len(seen) + 1))
                bound = seen[rank - 1] if rank >= 1 else float("-inf")
                missed = float(score < bound)
                out.append((rows["source"].iloc[0], window, alpha, bound, score, missed))
                alpha += gamma * (target - missed)
            insort(seen, float(score))
        return pd.DataFrame(out, columns=["source", "window", "alpha_t", "bound", "score", "miscovered"])

    rows = scores.select(F.col("source").cast("string").alias("source"), F.col("window").cast("long").alias("window"), F.col("score").cast("double").alias("score"))
    return rows.groupBy("source").applyInPandas(fold, "source string, window long, alpha_t double, bound double, score double, miscovered double")


