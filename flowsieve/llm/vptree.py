"""Nearest neighbours by vantage-point trees: one above, over a sample, and one in each shard.

The top tree is built on a bounded sample of the vectors. Its inner nodes, a vantage point and a radius each, cut space into regions; every
vector goes down to its region, and a region's vectors are dealt to shards of about SHARD by a hash of their id. A shard builds one tree: a node's
vantage point splits its vectors at the median distance; leaves hold up to LEAF of them. All queries of a block descend together: at a node each follows the side
it lies on, and the other only if its ball around the best distance so far, shrunk by `factor`, crosses the boundary.

A query first searches its own region. The distance of the k-th it found there is the ball that it takes down the top tree, where the same rule names
the other regions that it has to visit. Factor 1 never misses, in the top tree as in the shards; a larger one prunes more.

Copies of a vector: only the k + 1 smallest ids of equal vectors can be among anyone's k nearest, so that others are not searched; equal queries are
answered once. A crowd of equal vectors costs k + 1 rows. Vectors of each length have trees of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, table

SHARD, LEAF, BLOCK = 4096, 64, 2048
FACTOR = 1.15
#: Vectors of a length that the top tree is built on, and of them for a region; lengths with a top tree, the most frequent ones. Vectors of other lengths are one region a length.
SAMPLE, PER_REGION, LENGTHS = 8192, 32, 8


def _vectors(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


class Tree:
    """A vantage-point tree in arrays: inner nodes have a vantage vector, a radius and two children; leaves a range of rows."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.x = vectors
        self.rows = np.arange(len(vectors))
        self.nodes: list[tuple] = []
        self._build(0, len(vectors), leaf)

    def _build(self, a: int, b: int, leaf: int) -> int:
        me = len(self.nodes)
        self.nodes.append((a, b))
        stack = [(me, a, b)]
        while stack:
            at, a, b = stack.pop()
            part = self.rows[a:b]
            if b - a <= leaf:
                continue
            # The vantage point: of a few evenly spaced rows, the one whose distances spread most.
            best = max((self.x[part[i]] for i in range(0, b - a, max(1, (b - a) // 5))), key=lambda v: np.var(self._to(v, part)))
            d = self._to(best, part)
            radius = np.median(d)
            inside = d <= radius
            if inside.all():
                inside = d < radius
                if not inside.any():
                    continue  # all equally far: the node stays a leaf
                radius = d[inside].max()
            self.rows[a:b] = np.concatenate((part[inside], part[~inside]))
            mid = a + int(inside.sum())
            left, right = len(self.nodes), len(self.nodes) + 1
            self.nodes += [(a, mid), (mid, b)]
            self.nodes[at] = (a, b, best, radius, d[~inside].min(), left, right)
            stack += [(left, a, mid), (right, mid, b)]
        return me

    def _to(self, v: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.x[rows] - v) ** 2).sum(1))

    def search(self, queries: np.ndarray, own: np.ndarray | None, ids: np.ndarray, k: int, factor: float, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of each query's k nearest rows other than its own, nearest first, ties to the smaller id; inf and -1 where there are fewer.
        within: what is farther than this from a query need not be found."""
        n = len(queries)
        limit = np.full(n, np.inf) if within is None else within
        best = np.full((n, k), np.inf)
        who = np.full((n, k), np.iinfo(np.int64).max)

        def visit(at: int, q: np.ndarray) -> None:
            node = self.nodes[at]
            if len(node) == 2:
                for a in range(node[0], node[1], 1024):
                    rows = self.rows[a : min(a + 1024, node[1])]
                    for s in range(0, len(q), max(1, (1 << 21) // (len(rows) * self.x.shape[1]))):
                        part = q[s : s + max(1, (1 << 21) // (len(rows) * self.x.shape[1]))]
                        d = np.sqrt(((queries[part][:, None, :] - self.x[rows][None]) ** 2).sum(2))
                        if own is not None:
                            d[own[part][:, None] == ids[rows][None]] = np.inf
                        d = np.concatenate((best[part], d), 1)
                        i = np.concatenate((who[part], np.broadcast_to(ids[rows], (len(part), len(rows)))), 1)
                        order = np.lexsort((i, d), axis=1)[:, :k]
                        best[part], who[part] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
                return
            _, _, vantage, inner, outer, left, right = node
            d = np.sqrt(((queries[q] - vantage) ** 2).sum(1))
            nearer = d <= (inner + outer) / 2
            for first, second, mine in ((left, right, nearer), (right, left, ~nearer)):
                go, dist = q[mine], d[mine]
                if len(go):
                    visit(first, go)
                    gap = outer - dist if first == left else dist - inner
                    back = go[gap <= np.minimum(best[go, -1], limit[go]) / factor + 1e-12]
                    if len(back):
                        visit(second, back)

        if len(self.rows) and n:
            visit(0, np.arange(n))
        who[np.isinf(best)] = -1
        return best, who


class Regions:
    """The inner nodes of a tree over a sample, to be sent to tasks: at most twice as many vantage points as there are regions."""

    def __init__(self, sample: np.ndarray, per_region: int):
        tree = Tree(sample, per_region)
        self.nodes, self.n = [], 0
        for node in tree.nodes:
            if len(node) == 2:
                self.nodes.append(self.n)
                self.n += 1
            else:
                _, _, vantage, inner, outer, left, right = node
                self.nodes.append((vantage, (inner + outer) / 2, left, right))

    def of(self, x: np.ndarray) -> np.ndarray:
        """Region of each vector."""
        out = np.zeros(len(x), np.int32)
        stack = [(0, np.arange(len(x)))]
        while stack:
            at, rows = stack.pop()
            node = self.nodes[at]
            if isinstance(node, int):
                out[rows] = node
                continue
            vantage, radius, left, right = node
            inside = np.sqrt(((x[rows] - vantage) ** 2).sum(1)) <= radius
            stack += [(n, r) for n, r in ((left, rows[inside]), (right, rows[~inside])) if len(r)]
        return out

    def within(self, x: np.ndarray, ball: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, region) of all regions that may hold something no farther than each row's ball."""
        found = []
        stack = [(0, np.arange(len(x)))]
        while stack:
            at, rows = stack.pop()
            node = self.nodes[at]
            if isinstance(node, int):
                found.append((rows, np.full(len(rows), node, np.int32)))
                continue
            vantage, radius, left, right = node
            d = np.sqrt(((x[rows] - vantage) ** 2).sum(1))
            slack = ball[rows] + 1e-9 * (1 + radius)
            stack += [(n, r) for n, r in ((left, rows[d - radius <= slack]), (right, rows[radius - d <= slack])) if len(r)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal rows."""
    n = len(columns[0])
    new = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), n]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]


def _place(tops: dict[int, Regions], visits: bool, factor: float):
    """Rows (id, length, ball, vector) to (id, length, region, ball, vector): each vector's own region or, for visits, the others that its ball reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(1).to_numpy()
            order = np.argsort(length, kind="stable")
            for a, b in _runs(length[order]):
                rows = batch.take(pa.array(order[a:b]))
                x, top, n = _vectors(rows.column(3)), tops.get(int(length[order[a]])), b - a
                own = top.of(x) if top else np.zeros(n, np.int32)
                row, region = np.arange(n), own
                if visits:
                    row, region = top.within(x, rows.column(2).to_numpy() / factor) if top else (row[:0], own[:0])
                    row, region = row[region != own[row]], region[region != own[row]]
                for s in range(0, len(row), 4096):
                    part = rows.take(pa.array(row[s : s + 4096]))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(region[s : s + 4096]), part.column(2), part.column(3)], ["id", "length", "region", "ball", "vector"])

    return run


_PLACED = "id long, length int, region int, ball double, vector array<double>"


def _search(k: int, factor: float):
    """Rows (length, region, shard, query, id, ball, vector) in order of the first four: candidates come first, are indexed, and answer the queries that follow, BLOCK by BLOCK."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tree, ids, asked, waiting = None, [], None, None, [], 0

        def answers():
            nonlocal tree, ids, held, asked, waiting
            if not held or not asked:
                asked, waiting = [], 0
                return
            if tree is None:
                ids, x = (np.concatenate([h[i] for h in held]) for i in range(2))
                order = np.argsort(ids, kind="stable")
                ids, tree = ids[order], Tree(x[order])
            qids, ball, q = (np.concatenate([h[i] for h in asked]) for i in range(3))
            asked, waiting = [], 0
            for s in range(0, len(q), BLOCK):
                best, who = tree.search(q[s : s + BLOCK], None, ids, k, factor, ball[s : s + BLOCK])
                keep = (who >= 0) & (best <= ball[s : s + BLOCK, None])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids[s : s + BLOCK], keep.sum(1))), pa.array(who[keep]), pa.array(best[keep])], ["query_id", "vec_id", "score"])

        for batch in batches:
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            for a, b in _runs(*keys):
                key = tuple(int(c[a]) for c in keys[:3])
                if key != at:
                    yield from answers()
                    at, held, tree, ids = key, [], None, None
                part = batch.slice(a, b - a)
                who, x = part.column(4).to_numpy(), _vectors(part.column(6))
                if keys[3][a]:
                    asked.append((who, part.column(5).to_numpy(), x))
                    waiting += b - a
                    if waiting >= BLOCK:
                        yield from answers()
                else:
                    held.append((who, x))
        yield from answers()

    return run


def _tops(rows: DataFrame, shard: int) -> dict[int, Regions]:
    """Top trees of the LENGTHS most frequent lengths that need one, on the SAMPLE vectors of each with the smallest hashes."""
    out = {}
    for r in rows.groupBy("length").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").limit(LENGTHS).collect():
        if r["n"] <= shard:
            continue
        sample = rows.where(F.col("length") == r["length"]).select("vector", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE).select("vector").toArrow()
        regions = min(SAMPLE // PER_REGION, -(-r["n"] // shard))
        out[r["length"]] = Regions(_vectors(sample.column(0)), max(1, sample.num_rows // regions))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = FACTOR, shard: int = SHARD) -> DataFrame:
    """A row for each query and rank: query_id, rank (from 1), vec_id, score (Euclidean distance, double precision).

    Both tables: vec_id and embedding (array); other columns are ignored. A query's own id is no candidate. Vectors
    that are null, empty, all zero, or hold null or non-finite components take no part, nor rows with a null id. Vectors of different lengths have no distance: a
    query's candidates are those of its length. Repeated rows count once; an id with several vectors is at the distance of the nearest, and as a query has the
    smallest of them. Ties go to the smaller vec_id. With fewer than k candidates all come back. Empty tables give no rows."""
    if factor < 1:
        raise ValueError("factor must be 1 or more")

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        ok = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
        rows = df.select(F.col("vec_id").cast("long").alias("id"), v.alias("vector")).where(F.coalesce(ok, F.lit(False)))
        return rows.select("id", F.size("vector").alias("length"), F.lit(float("inf")).alias("ball"), F.transform("vector", lambda c: c + 0.0).alias("vector"))

    rows = cut(usable(vectors))
    # Only the smallest ids of equal vectors: each task passes on k + 1 of them at most.
    first = F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))
    tops = _tops(rows, shard)
    some = rows.withColumn("r", first).where(F.col("r") <= k + 1).drop("r").dropDuplicates(["vector", "id"])
    placed = cut(some.mapInArrow(_place(tops, False, factor), _PLACED))
    sizes = placed.groupBy("length", "region").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    named = cut(usable(queries).groupBy("id").agg(F.min("vector").alias("vector")))
    asked = named.groupBy("vector").agg(F.min("id").alias("id")).select("id", F.size("vector").alias("length"), F.lit(float("inf")).alias("ball"), "vector")

    candidates = placed.join(sizes, ["length", "region"]).select("length", "region", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int").alias("shard"), F.lit(False).alias("query"), "id", "ball", "vector")

    def search(visits: DataFrame) -> DataFrame:
        every = visits.join(sizes, ["length", "region"]).select("length", "region", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(True).alias("query"), "id", "ball", "vector")
        dealt = candidates.union(every).repartition("length", "region", "shard").sortWithinPartitions("length", "region", "shard", "query", "id")
        return dealt.mapInArrow(_search(k + 1, factor), "query_id long, vec_id long, score double")

    best = lambda found: found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1)
    near = cut(best(search(asked.mapInArrow(_place(tops, False, factor), _PLACED))))
    found = near.drop("r")
    if tops:
        balls = near.where(F.col("r") == k + 1).select("query_id", F.col("score").alias("reach"))
        reach = asked.drop("ball").join(balls, F.col("id") == F.col("query_id"), "left").select("id", "length", F.coalesce("reach", F.lit(float("inf"))).alias("ball"), "vector")
        found = best(found.union(search(reach.mapInArrow(_place(tops, True, factor), _PLACED)))).drop("r")
    own = named.join(asked.select(F.col("id").alias("query_id"), F.col("vector").alias("same")), F.col("vector") == F.col("same")).select("id", "query_id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("score", "vec_id"))
    out = own.join(found, "query_id").where("vec_id <> id").withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select(F.col("id").alias("query_id"), "rank", "vec_id", "score")


def op7_vantage_point_search(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 100 = 0"))
