import numpy as np
import pytest

from flowsieve.llm.vptree import Regions, Tree, nearest

SCHEMA = "vec_id long, embedding array<float>, score string, shard int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[50:120] = x[3]  # a crowd of equal vectors
    rows = [(i, [float(v) for v in x[i]], "s", 1) for i in range(400)]
    rows += [(1000, None, "s", 1), (1001, [0.0] * 8, "s", 1), (1002, [float("nan")] + [1.0] * 7, "s", 1), (1003, [None] + [1.0] * 7, "s", 1), (1004, [float("inf")] + [1.0] * 7, "s", 1), (None, [1.0] * 8, "s", 1), (1005, [1.0] * 3, "s", 1), rows[7]]
    return x.astype(float), spark.createDataFrame(rows, SCHEMA).repartition(3)


def want(x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    return [(int(i), d[i]) for i in np.lexsort((np.arange(len(x)), d)) if i != q][:k]


def test_factor_one_is_exact(vectors):
    x, df = vectors
    rows = nearest(df, df.where("vec_id % 20 = 0 or vec_id is null"), 10, 1.0, shard=100).collect()
    for q in range(0, 400, 20):
        got = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, 11))
        assert [r.vec_id for r in got] == [i for i, _ in want(x, q, 10)]
        assert np.allclose([r.score for r in got], [d for _, d in want(x, q, 10)], rtol=1e-12)
    assert {r.query_id for r in rows} == set(range(0, 400, 20))


def test_relaxed_recall(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = df.toPandas().sort_values("vec_id")
    ids, m = x.vec_id.to_numpy(), np.stack(x.embedding).astype(float)
    rows = nearest(df, df.where("vec_id % 100 = 0")).collect()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((m - m[ids == q][0]) ** 2).sum(1))
        true = {int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q and True}
        best = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        assert true
        hits += len(set(best) & {r.vec_id for r in rows if r.query_id == q})
        total += len(best)
    assert hits >= 0.9 * total


def test_pruning_visits_fewer(vectors):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 3))
    tree = Tree(x)
    best, who = tree.search(x[:50], np.arange(50), np.arange(3000), 5, 1.0)
    for q in range(50):
        assert who[q].tolist() == [i for i, _ in want(x, q, 5)]
    assert sum(len(n) == 2 for n in tree.nodes) > 10


def test_few_and_none(vectors, spark):
    _, df = vectors
    few = df.where("vec_id < 4")
    assert nearest(few, few).groupBy("query_id").count().collect()[0]["count"] == 3
    assert nearest(df.limit(0), df).count() == 0 and nearest(df, df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        nearest(df, df, factor=0.5)


def brute(rows, k, asked):
    out = {}
    for q, v in rows:
        if asked(q):
            d = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in rows if i != q and len(w) == len(v))
            out[q] = d[:k]
    return out


def test_lengths_copies_and_regions(spark):
    """Three lengths, one of them rare; a third of all rows equal; regions of several shards. Factor 1 is exact, through both levels."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 4)) * 20
    rows = [(i, (centres[i % 6] + rng.normal(size=4)).tolist()) for i in range(600)] + [(600 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(400)]
    rows += [(2000 + i, rng.normal(size=7).round(1).tolist()) for i in range(300)] + [(3000 + i, rng.normal(size=2).tolist()) for i in range(5)] + [(4000, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in nearest(df, df.where("vec_id % 20 = 0"), 10, 1.0, shard=40).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    true = brute(rows, 10, lambda q: q % 20 == 0)
    assert set(got) == {q for q, d in true.items() if d}
    for q, found in got.items():
        found.sort()
        assert [i for _, _, i in found] == [i for _, i in true[q]]
        assert np.allclose([d for _, d, _ in found], [d for d, _ in true[q]], rtol=1e-12)
    relaxed = nearest(df, df.where("vec_id % 20 = 0"), 10, 1.15, shard=40).collect()
    hits = sum(r.vec_id in {i for _, i in true[r.query_id]} for r in relaxed)
    assert hits >= 0.9 * sum(map(len, true.values()))


def test_regions_leave_out_what_is_far():
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(20, 6)) * 30)[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 6))
    top = Regions(x[:1000], 50)
    own = top.of(x)
    row, region = top.within(x[:200], np.full(200, 4.0))
    assert len(row) < 0.4 * 200 * top.n
    visited = set(zip(row.tolist(), region.tolist()))
    for q in range(200):
        near = np.flatnonzero(np.sqrt(((x - x[q]) ** 2).sum(1)) <= 4.0)
        assert all((q, r) in visited for r in own[near].tolist())


def test_query_against_brute_force(spark, sf):
    """op7 itself: every query there, scores exact, recall by the contract's measure."""
    from flowsieve.llm.vptree import op7_vantage_point_search

    rows = [(r.vec_id, list(map(float, r.embedding))) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding is not None and any(r.embedding)]
    true, vectors = brute(rows, 10, lambda q: q % 100 == 0), dict(rows)
    got = {}
    for r in op7_vantage_point_search(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(true)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(abs(np.sqrt(((np.array(vectors[q]) - np.array(vectors[i])) ** 2).sum()) - d) < 1e-9 for _, i, d in found)
        hits += len({i for _, i, _ in found} & {i for _, i in true[q]})
    assert hits >= 0.9 * 10 * len(true)
