"""Connected components of a graph given as links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, partitions_for

LINKS_PER_TASK = 250_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one task to (node, smallest node reachable by them)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.fromiter(parent, np.int64, len(parent))
    roots = np.fromiter((root(x) for x in list(parent)), np.int64, len(parent))
    for i in range(0, len(nodes), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 65536]), pa.array(roots[i : i + 65536])], ["node", "component"])


def _star_step(edges: DataFrame) -> DataFrame:
    """Large star, then small star: neighbours are linked to the smallest node around."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
    small = large.join(low, F.col("a") == F.col("k"))
    return small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("k", "m")).distinct()


def components(links: DataFrame, per_task: int = LINKS_PER_TASK, written: bool = False) -> DataFrame:
    """(node, component): component is the smallest node reachable; nodes without links don't appear.

    links: two integer columns, in any order, repeats and self-links allowed; null ends are dropped. written: they come from a table, so that reading them twice costs little.
    Tasks of at most `per_task` links first reduce theirs to a forest, which never has more rows than
    links. If one task held them all, that is the answer; else star steps on the forests follow,
    each a few aggregations and joins, in O(log n) rounds. Hubs are safe: minima combine before the exchange,
    and the joins can be split by Spark. Nothing but two sums reaches the driver."""
    a, b = links.columns[:2]
    links = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    links = links if written else cut(links)
    parts = partitions_for(links.count(), per_task)
    forest = links.repartition(parts).mapInArrow(_forest, "node long, component long")
    if parts == 1:
        return cut(forest)
    nodes = cut(forest)
    edges, before = cut(nodes.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).distinct()), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, edges = now, cut(_star_step(edges))
    stars = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    every = nodes.select("node").union(nodes.select("component")).distinct()
    return cut(every.join(stars, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
