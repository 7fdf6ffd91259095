"""What memory a certified top k costs, and the router that weighs it against exact execution."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .conformal import budget_threshold

#: Fixed: bytes of a counter and of a tracked candidate; memory above which a sketch isn't worth it.
COUNTER, CANDIDATE, NOT_WORTH = 8, 32, 1_000_000_000
E = math.e


def capacity_for_width(gap: Column, width: Column) -> Column:
    """Least capacity that certifies a gap at a width: max(1, ceil(1 / (L/2 - e/m)) - 1), null where none does."""
    slack = gap / 2 - F.lit(E) / width
    return F.when(slack > 0, F.greatest(F.ceil(1 / slack) - 1, F.lit(1)).cast("long"))


def margin(gap: Column, width: Column, capacity: Column) -> Column:
    return gap - budget_threshold(width, capacity)


def price(gaps: DataFrame, depth: int = 5, counter: int = COUNTER, candidate: int = CANDIDATE) -> DataFrame:
    """gaps (with column gap) and the cheapest certifying (width, capacity): feasible, width, capacity, sketch_bytes, candidate_bytes, total_bytes, margin.

    Memory as a function of width has its least value near m = (2/L)(e + sqrt(e * candidate / (depth * counter))). Integer capacities make steps, so the widths
    where the capacity changes are tried: for capacity c the least width is ceil(e / (L/2 - 1/(c+1))). Away from the optimum c* memory grows by
    candidate * (c - c*)^2 / c* bytes at least, and what rounding can give back are two counters of each row: so many capacities on either side are enough. Ties go to the
    smaller width."""
    gap = F.col("gap")
    ok = (gap > 0) & (gap < float("inf")) & ~F.isnan(gap)
    best = (2 / gap) * (E + math.sqrt(E * candidate / (depth * counter)))
    start = F.greatest(F.ceil(1 / (gap / 2 - E / best)) - 1, F.lit(1))
    span = F.ceil(math.sqrt(2 * depth * counter / candidate) * F.sqrt(start)) + 16
    rows = gaps.withColumn("__ok", ok)
    tries = rows.where("__ok").select("gap").distinct().withColumn("capacity", F.explode(F.sequence(F.greatest(start - span, F.lit(1)), start + span)))
    least = F.ceil(F.lit(E) / (gap / 2 - 1 / (F.col("capacity") + 1)))
    tries = tries.where(gap / 2 - 1 / (F.col("capacity") + 1) > 0).withColumn("width", F.explode(F.array(least, least + 1))).withColumn("capacity", capacity_for_width(gap, F.col("width"))).where("capacity is not null")
    tries = tries.withColumn("total", F.col("width") * (depth * counter) + F.col("capacity") * candidate)
    found = tries.groupBy(gap.alias("__gap")).agg(F.min(F.struct("total", "width", "capacity")).alias("b"))
    out = rows.join(found, gap == F.col("__gap"), "left")  # by the gap itself: the price is a function of it
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        *gaps.columns, F.col("__ok").alias("feasible"), zero(F.col("b.width")).alias("width"), zero(F.col("b.capacity")).alias("capacity"), zero(F.col("b.width") * (depth * counter)).alias("sketch_bytes"), zero(F.col("b.capacity") * candidate).alias("candidate_bytes"), zero(F.col("b.total")).alias("total_bytes"),
        F.coalesce(margin(gap, F.col("b.width"), F.col("b.capacity")), F.lit(float("-inf"))).alias("margin"),
    )


def best_index(gaps: DataFrame, total_bytes: int, depth: int = 5, counter: int = COUNTER, candidate: int = CANDIDATE) -> DataFrame:
    """gaps with best_index: gap over the least threshold of 39 even splits of the memory; 0 where no split or gap serves."""
    splits = gaps.sparkSession.range(1, 40).select((F.col("id") / 40.0).alias("f"))
    splits = splits.select(F.floor(F.col("f") * total_bytes / (depth * counter)).alias("w"), F.floor((1 - F.col("f")) * total_bytes / candidate).alias("c")).where("w >= 8 and c >= 1")
    least = splits.agg(F.min(budget_threshold(F.col("w"), F.col("c"))).alias("__least"))
    return gaps.join(F.broadcast(least)).withColumn("best_index", F.when((F.col("gap") > 0) & F.col("__least").isNotNull(), F.col("gap") / F.col("__least")).otherwise(0.0)).drop("__least")


def with_bounds(rows: DataFrame, bounds: DataFrame, suffix: str = "_edges", name: str = "gap") -> DataFrame:
    """rows (source, ...) with the bound of their source from bounds (source, bound): by its name, else by its name without every `suffix`, else 0; never below 0.
    Where a source has several bounds, the least counts."""
    known = bounds.groupBy("source").agg(F.min("bound").alias("b"))
    own = known.select(F.col("source").alias("__own"), F.col("b").alias("__b"))
    other = known.select(F.col("source").alias("__other"), F.col("b").alias("__c"))
    out = rows.join(own, F.col("source") == F.col("__own"), "left").join(other, F.replace(F.col("source"), F.lit(suffix), F.lit("")) == F.col("__other"), "left")
    bound = F.greatest(F.coalesce("__b", "__c", F.lit(0.0)), F.lit(0.0))
    return out.withColumn(name, bound).drop("__own", "__b", "__other", "__c")


def identifiability_index(gap: Column, width: Column, capacity: Column) -> Column:
    return gap / budget_threshold(width, capacity)


def route(rows: DataFrame, memory_budget: int = 64_000_000, depth: int = 5, profile_margin: float = 1.2) -> DataFrame:
    """rows (sparse_seconds, pandas_seconds, gap, heuristic, native) with the decision.

    Timings are given, never taken: results stay the same from run to run. The exact build is committed to only if profile and heuristic agree."""
    ratio = F.col("pandas_seconds") / F.greatest(F.col("sparse_seconds"), F.lit(1e-12))
    profile = F.when(ratio > profile_margin, "sparse_direct").when(ratio < 1.0 / profile_margin, "pandas_groupby").otherwise("indecisive")
    out = price(rows, depth).withColumn("profile_choice", profile)
    agree = F.col("profile_choice") == F.col("heuristic")
    out = out.withColumn("exact_choice", F.when(agree, F.col("profile_choice")).otherwise("sparse_direct"))
    out = out.withColumn("exact_source", F.when(agree, "agreement").when(F.col("profile_choice") == "indecisive", "profile undecided").otherwise("disagreement"))
    sketch = F.when(~F.col("feasible"), "unidentifiable").when(F.col("total_bytes") > NOT_WORTH, "not_worth_it").when(F.col("total_bytes") <= memory_budget, "certifiable_within_budget").otherwise("certifiable_over_budget")
    out = out.withColumn("sketch_decision", sketch).withColumn("within_budget", F.col("feasible") & (F.col("total_bytes") <= memory_budget))
    base = F.when(F.col("native"), "graphblas_hypersparse").otherwise("scipy_csr")
    out = out.withColumn("backend", F.when(F.col("exact_choice") == "pandas_groupby", F.concat(F.lit("pandas_then_"), base)).otherwise(base))
    return out.withColumn("online_route", F.when(F.col("within_budget") & (F.col("sketch_decision") == "certifiable_within_budget"), "sketch").otherwise("exact")).withColumn("batch_route", F.lit("exact"))
