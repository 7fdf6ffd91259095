"""Mixing sources to target weights by hash-threshold histograms.

A document's hash decides where it stands in its source. Each source needs its whole documents some times over and then
those below a threshold, which is found from sums of sizes by source and hash bucket: buckets before the one that crosses the budget are
taken, and only that boundary bucket is looked at again, at BITS more bits. Nothing is sorted by row, and a larger budget
keeps all that a smaller one took.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, free, table

BITS, HASH_BITS = 10, 60
#: Sources that are broadcast, those with most rows.
MOST_SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with rank, from 0 in order of name, null last; no task sees more than a range of them."""
    placed = cut(sources.repartitionByRange(F.asc_nulls_last("source")).sortWithinPartitions(F.asc_nulls_last("source")).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    counts, first, before = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}, [], 0
    for part in sorted(counts):
        first.append((part, before))
        before += counts[part]
    heads = sources.sparkSession.createDataFrame(first, "part int, first long")
    return placed.join(F.broadcast(heads), "part").select("source", "source_size", "rows", (F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, rows) to (source, source_size, rows, target).

    In order of name, null last, sources weigh `weights`, repeating, and share the sum of all sizes; a target stops at `most` times
    its source's size, and the excess is shared again among the rest until none is above."""
    ranked = cut(_ranked(sources).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1).cast("long")))
    ranked = ranked.withColumn("most", F.col("source_size") * most)
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    # A source is full if its share is more than it may take. Each round shares what full ones leave; full ones stay full.
    full, share, before = F.lit(False), None, -1
    while True:
        got = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0)).alias("most"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"), F.count(F.when(full, 1)).alias("n")).first()
        if got["n"] == before:
            return ranked.select("source", "source_size", "rows", F.when(full, F.col("most").cast("double")).otherwise(share).alias("target"))
        before = got["n"]
        share = F.col("weight") * F.lit(float(total - got["most"])) / F.lit(float(got["weight"] or 1))
        full = share > F.col("most")


def hash_of(id_: Column, seed: str = "") -> Column:
    """A hash of an id below 2**60; null has one too."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(id_.cast("long").cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def sizes(docs: DataFrame, seed: str = "") -> DataFrame:
    """doc_id, source, size (words of the text, 0 if null) and h, the hash of doc_id."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), hash_of(F.col("doc_id"), seed).alias("h"))


def thresholds(rows: DataFrame, budgets: DataFrame, bits: int = BITS) -> DataFrame:
    """(source, h, size) and (source, rest) to (source, bound): the sizes of rows with h < bound add up to about rest.

    The row on the boundary is taken if that comes nearer to the budget; rows that share all bits of h stand or fall together."""
    state = budgets.select("source", F.col("rest").cast("double").alias("rest"), F.lit(0).cast("long").alias("low"))
    done, inside, low_bits = None, rows, HASH_BITS
    while True:
        low_bits -= bits
        bucket = F.shiftright(F.col("h"), low_bits)
        hist = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        up_to = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("sum", F.sum("words").over(up_to)).alias("x")
        crossed = hist.join(state.alias("s"), F.col("x.source").eqNullSafe(F.col("s.source"))).where("sum > rest")
        first = crossed.groupBy("x.source").agg(F.min(F.struct("bucket", "words", "n", "sum", "rest")).alias("b")).select("source", "b.*")
        edge = cut(first.select("source", "bucket", "n", "words", (F.col("rest") - (F.col("sum") - F.col("words"))).alias("rest")))
        single = edge.where(F.lit(low_bits == 0) | (F.col("n") == 1))
        found = single.select("source", F.shiftleft(F.col("bucket") + F.when(F.col("rest") * 2 >= F.col("words"), 1).otherwise(0), low_bits).alias("bound"))
        done = found if done is None else done.unionByName(found)
        open_ = edge.where(F.lit(low_bits > 0) & (F.col("n") > 1))
        if not open_.limit(1).count():
            break
        state = open_.select("source", "rest")
        edges = open_.select(F.col("source").alias("__s"), F.col("bucket").alias("__b"))
        inside = cut(inside.join(edges, F.col("source").eqNullSafe(F.col("__s")) & (bucket == F.col("__b"))).select("source", "h", "size"))
    every = budgets.select("source", "rest").alias("a").join(done.alias("d"), F.col("a.source").eqNullSafe(F.col("d.source")), "left")
    return every.select("a.source", F.coalesce("bound", F.when(F.col("rest") > 0, F.lit(1 << HASH_BITS)).otherwise(0)).cast("long").alias("bound"))


def shares(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """A row for each source of sizes(): source, source_size, rows, target, whole, bound. The mix takes each of its documents `whole` times, and once
    more if its h is below bound."""
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = cut(goals.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    return cut(goals.alias("g").join(thresholds(rows, goals).alias("t"), F.col("g.source").eqNullSafe(F.col("t.source"))).select("g.*", "bound"))


def _join_sources(df: DataFrame, source: Column, goals: DataFrame, names: list[str]) -> DataFrame:
    """df with goals' columns by source, null equal to null. goals' columns are called `names` then, the source first.

    The MOST_SOURCES sources with most rows are broadcast. Rows of others, which hold one in MOST_SOURCES each at most, are joined by exchange."""
    goals = goals.select("source", *(c for c in goals.columns if c != "source"))
    renamed = goals.toDF(*names)
    on = source.eqNullSafe(F.col(names[0]))
    if goals.count() <= MOST_SOURCES:
        return df.join(F.broadcast(renamed), on)
    large = cut(goals.orderBy(F.desc("rows"), F.asc_nulls_last("source")).limit(MOST_SOURCES)).toDF(*names)
    small = renamed.join(F.broadcast(large.select(F.col(names[0]).alias("__s"))), F.col(names[0]).eqNullSafe(F.col("__s")), "left_anti")
    return df.join(F.broadcast(large), on).unionByName(df.join(F.broadcast(large.select(names[0])), on, "left_anti").join(small, on))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "") -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, repeats, taken.

    docs: doc_id, text, source; other columns are ignored. The mix takes a document `repeats` times, 0 to `most`, and so
    taken = repeats * size words. A source's taken words miss its target by half a document at most (repeated doc_ids
    stand or fall together). Null sources are one source, ordered last; a null or empty text has size 0, one of any length is counted whole. The result depends on ids and sizes only, so that
    reruns agree. An empty table gives an empty table."""
    rows = cut(sizes(docs, seed))
    goals = shares(rows, weights, most)
    out = _join_sources(rows, F.col("source"), goals, ["__source", *(c for c in goals.columns if c != "source")])
    repeats = F.least(F.col("whole") + (F.col("h") < F.col("bound")).cast("long"), F.lit(most))
    return out.select("doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "") -> DataFrame:
    """The rows of docs, each as often as mix() takes it: 0 to `most` times.

    What a row is taken depends on the row and its source alone, so that texts stay where they are. Rows that share a doc_id and a source are taken
    equally often. An empty table gives an empty table."""
    goals = shares(cut(sizes(docs, seed)), weights, most)
    names = free(docs, "source_", "source_size", "rows", "target", "whole", "rest", "bound", "nth")
    out = _join_sources(docs, F.col("source").cast("string"), goals, names[:-1])
    times = F.least(F.col(names[4]) + (hash_of(F.col("doc_id"), seed) < F.col(names[6])).cast("long"), F.lit(most)).cast("int")
    return out.where(times > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), times)).alias(names[-1])).select(*docs.columns)


def op9_hash_threshold_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, sum(source_size) OVER () AS total,
         sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) - 3 * source_size AS full_before,
         sum(w) OVER () - sum(w) OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) + w AS w_left
  FROM s),
t AS (
  SELECT *, CAST(w AS DOUBLE) * CAST(total - full_before AS DOUBLE) / CAST(w_left AS DOUBLE) > 3 * source_size AS is_full FROM o),
u AS (
  SELECT sum(CASE WHEN is_full THEN 3 * source_size ELSE 0 END) AS m, sum(CASE WHEN is_full THEN 0 ELSE w END) AS ws FROM t),
g AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(w AS DOUBLE) * CAST(total - m AS DOUBLE) / CAST(ws AS DOUBLE) END AS target
  FROM t, u),
k AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
c AS (
  SELECT d.doc_id, d.source, d.size, k.source_size, k.target, k.whole, k.target - k.whole * k.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY h) AS upto
  FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target,
       CAST(size * least(3, whole + CASE WHEN upto <= rest OR (upto - size <= rest AND (rest - (upto - size)) * 2 >= size) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       source
FROM c
"""
