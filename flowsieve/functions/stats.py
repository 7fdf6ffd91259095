"""Aggregate expressions over weights: entropy, concentration, shares. All are single-pass and combine before the exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


#: Rows of a histogram that one task may sort.
SMALL = 1_000_000


def positive(w: Column) -> Column:
    return F.when(w > 0, w)


def entropy_bits(weight: str) -> Column:
    """Shannon entropy in bits of the positive weights of a group; 0 if there are none. log2(W) - sum(w log2 w) / W."""
    w = positive(F.col(weight).cast("double"))
    total = F.sum(w)
    return F.coalesce(F.when(total > 0, F.greatest(F.log2(total) - F.sum(w * F.log2(w)) / total, F.lit(0.0))), F.lit(0.0))


def share(part: Column, total: Column) -> Column:
    """part / total as a double, 0 where the total is 0 or null."""
    return F.coalesce(F.when(total > 0, part.cast("double") / total.cast("double")), F.lit(0.0))


def gini(df: DataFrame, weight: str, by: list[str], ranges: int | None = None, rows: int | None = None) -> DataFrame:
    """Gini coefficient of a weight column for each group: by, gini.

    Equal weights are counted first. Ranks then follow from a running count over distinct weights, so that the window
    sees a histogram and not the rows. A histogram of more than SMALL rows is cut into ranges, groups too, so that no single task sorts it all; `ranges`
    asks for that many in any case. rows: how many rows df has at most, where that is known; it saves a look at the histogram."""
    from ..operators.ordering import durable, with_sequence

    hist = df.groupBy(*by, F.col(weight).cast("double").alias("w")).agg(F.count("*").cast("double").alias("c"))
    small = rows is not None and rows <= SMALL and not ranges
    if not small:
        hist = durable(hist)
        small = not ranges and hist.count() <= SMALL
    if not small:
        ranked = with_sequence(hist, ["w"], count="c", name="b", partitions=ranges, by=tuple(by))
    else:
        before = F.sum("c").over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("w").rowsBetween(Window.unboundedPreceding, -1))
        ranked = hist.withColumn("b", F.coalesce(before, F.lit(0.0)))
    n, total = F.sum("c"), F.sum(F.col("w") * F.col("c"))
    ranks = F.sum(F.col("w") * (F.col("c") * F.col("b") + F.col("c") * (F.col("c") + 1) / 2))
    value = F.coalesce(F.when(total > 0, 2 * ranks / (n * total) - (n + 1) / n), F.lit(0.0))
    return ranked.groupBy(*by).agg(value.alias("gini"))


def gini_total(df: DataFrame, weight: str, ranges: int | None = None, rows: int | None = None) -> DataFrame:
    """Gini coefficient of a whole column, one row; 0 without rows."""
    return gini(df, weight, [], ranges, rows)
