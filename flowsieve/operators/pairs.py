"""The traffic matrix as a pair table: one row (src, dst, weight) for each stored cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

STRATEGIES = ("direct", "preaggregate", "sort")


def aggregate_pairs(edges: DataFrame, by: tuple[str, ...] = (), strategy: str = "direct", salt: int = 16) -> DataFrame:
    """Sums weights by source and destination, and by the columns in `by` if any.

    direct: partial sums, one exchange, final sums. preaggregate: a salted first level for inputs whose pairs repeat so
    unevenly that one pair fills a task even after partial sums; the salt is a hash of the row, so that a rerun of a lost task deals alike. sort: rows are dealt and sorted by pair first, for inputs with next to no repeats."""
    keys = [*by, "src", "dst"]
    total = F.sum("weight").alias("weight")
    if strategy == "direct":
        return edges.groupBy(*keys).agg(total)
    if strategy == "preaggregate":
        salted = edges.withColumn("__salt", F.pmod(F.xxhash64(*edges.columns), F.lit(salt)))
        return salted.groupBy(*keys, "__salt").agg(total).groupBy(*keys).agg(total)
    if strategy == "sort":
        return edges.repartition(*keys).sortWithinPartitions(*keys).groupBy(*keys).agg(total)
    raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(STRATEGIES)}")


def with_labels(edges: DataFrame, sources: DataFrame | None = None, destinations: DataFrame | None = None) -> DataFrame:
    """Checks edges against label tables (one column each). Unknown labels are an error that names some of them."""
    for side, labels in (("src", sources), ("dst", destinations)):
        if labels is not None:
            unknown = edges.join(labels.select(F.col(labels.columns[0]).alias(side)), side, "left_anti").select(side).distinct().limit(5).collect()
            if unknown:
                raise ValueError(f"unknown {side} labels: {sorted(str(r[0]) for r in unknown)}")
    return edges


def coded_pairs(pairs: DataFrame) -> DataFrame:
    """row, col, weight: labels replaced by their rank, from 0, as a sparse matrix file needs."""
    from .ordering import with_sequence

    rows = with_sequence(pairs.select("src").distinct(), ["src"], name="row")
    cols = with_sequence(pairs.select("dst").distinct(), ["dst"], name="col")
    return pairs.join(rows, "src").join(cols, "dst").select("row", "col", "weight")


def top_k_edges(pairs: DataFrame, k: int = 20) -> DataFrame:
    """rank, src, dst, weight of the k heaviest pairs; ties by src, then dst. Each task keeps k rows."""
    best = pairs.orderBy(F.desc("weight"), "src", "dst").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("weight"), "src", "dst"))
    return best.select(rank.cast("long").alias("rank"), "src", "dst", "weight")


def strengths(pairs: DataFrame, axis: str) -> DataFrame:
    """label, strength, degree of sources or destinations."""
    if axis not in ("src", "dst"):
        raise ValueError(f"axis must be 'src' or 'dst', not {axis!r}")
    return pairs.groupBy(F.col(axis).alias("label")).agg(F.sum("weight").alias("strength"), F.count("*").alias("degree"))


def strength_distribution(pairs: DataFrame, axis: str) -> DataFrame:
    """strengths, strongest first."""
    return strengths(pairs, axis).orderBy(F.desc("strength"), F.desc("degree"), "label")


def vertex_rollup(pairs: DataFrame) -> DataFrame:
    """Strength and degree of every source, every destination and the whole, by grouping sets: one pass."""
    pairs.createOrReplaceTempView("__pairs")
    return pairs.sparkSession.sql(
        """SELECT CASE WHEN grouping(src) = 0 THEN 'src' WHEN grouping(dst) = 0 THEN 'dst' ELSE 'all' END AS axis,
                  coalesce(CAST(src AS STRING), CAST(dst AS STRING)) AS label, sum(weight) AS strength, count(*) AS degree
           FROM __pairs GROUP BY GROUPING SETS ((src), (dst), ())"""
    )


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: cells of each side, cells on one side only, and the largest difference; equivalent if below 1e-9."""
    l, r = (d.select("src", "dst", F.col("weight").cast("double").alias(n)) for d, n in ((left, "l"), (right, "r")))
    both = l.join(r, ["src", "dst"], "full_outer")
    gap = F.coalesce(F.max(F.abs(F.coalesce("l", F.lit(0.0)) - F.coalesce("r", F.lit(0.0)))), F.lit(0.0))
    out = both.agg(F.count("l").alias("left_nnz"), F.count("r").alias("right_nnz"), F.count(F.when(F.col("l").isNull() | F.col("r").isNull(), 1)).alias("unmatched"), gap.alias("max_difference"))
    return out.withColumn("equivalent", (F.col("unmatched") == 0) & (F.col("max_difference") < 1e-9))


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Multiset equality."""
    return not left.exceptAll(right).limit(1).count() and not right.exceptAll(left).limit(1).count()


def window_differences(left: DataFrame, right: DataFrame, window_edges: int = 131_072) -> DataFrame:
    """A row for each window of window_edges records: window, left_rows, right_rows, unmatched (rows of either side that the other lacks, counted with
    repeats) and equal. Both sides: seq, src, dst. Records are counted by pair first, so that the comparison meets counts and not rows."""
    side = lambda df, n: df.groupBy(F.expr(f"seq div {window_edges}").alias("window"), "src", "dst").agg(F.count("*").alias(n))
    both = side(left, "l").join(side(right, "r"), ["window", "src", "dst"], "full_outer").select("window", F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("r", F.lit(0)).alias("r"))
    out = both.groupBy("window").agg(F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"), F.sum(F.abs(F.col("l") - F.col("r"))).alias("unmatched"))
    return out.withColumn("equal", F.col("unmatched") == 0)
