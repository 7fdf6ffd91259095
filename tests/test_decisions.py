import math
import random

import pytest

from flowsieve.operators import conformal, pricing, sketches
from flowsieve.sources import fixtures as fx


def scores(spark, values, source="s"):
    return spark.createDataFrame([(source, i, float(v)) for i, v in enumerate(values)], "source string, window long, score double")


def test_prices(spark):
    gaps = spark.createDataFrame([(3.0811065327336545e-05,), (4.4079887626703126e-05,), (0.0,), (float("nan"),)], "gap double")
    got = [(r.feasible, r.width, r.capacity, r.total_bytes) for r in pricing.price(gaps).collect()]
    assert sorted(got, key=str) == sorted([(True, 272058, 184706, 16792912), (True, 190131, 129147, 11737944), (False, 0, 0, 0), (False, 0, 0, 0)], key=str)


def test_thresholds_and_small_samples(spark):
    assert conformal.budget_threshold(8192, 512) == pytest.approx(0.00456227850210898, rel=1e-12)
    assert conformal.budget_threshold(16384, 5000) == pytest.approx(0.0007317415282598677, rel=1e-12)
    row = conformal.lower_bounds(scores(spark, [0.5, 0.6, 0.7]), (0.1,)).first()
    assert (row["rank"], row.bound) == (0, -math.inf)


def test_bound_is_an_order_statistic(spark):
    values = [random.Random(3).expovariate(1) for _ in range(60)]
    row = conformal.lower_bounds(scores(spark, values), (0.1,)).first()
    assert row.bound == sorted(values)[conformal.conformal_rank(0.1, 60) - 1]


def test_coverage_and_adaptive(spark):
    rng = random.Random(5)
    drift = scores(spark, [rng.gauss(1 - i / 300, 0.1) for i in range(300)])
    assert abs(conformal.adaptive(drift).agg({"miscovered": "avg"}).first()[0] - 0.1) < 0.08
    constant = conformal.coverage(scores(spark, [0.3] * 99)).collect()
    assert all(r.valid and r.coverage == 1.0 for r in constant)
    alone = conformal.coverage(scores(spark, [0.3]), calibration=1).first()
    assert alone.coverage is None and alone.valid is None


def test_router(spark):
    rows = [("a", 0.01, 0.03, 4.4e-5, "sparse_direct"), ("b", 0.01, 0.03, 4.4e-5, "pandas_groupby"), ("c", 0.01, 0.03, 0.0, "sparse_direct"), ("d", 0.01, 0.03, 1.1e-7, "sparse_direct")]
    df = spark.createDataFrame([(*r, False) for r in rows], "id string, sparse_seconds double, pandas_seconds double, gap double, heuristic string, native boolean")
    got = {r.id: (r.exact_choice, r.exact_source, r.sketch_decision) for r in pricing.route(df).collect()}
    assert got == {"a": ("sparse_direct", "agreement", "certifiable_within_budget"), "b": ("sparse_direct", "disagreement", "certifiable_within_budget"), "c": ("sparse_direct", "agreement", "unidentifiable"), "d": ("sparse_direct", "agreement", "not_worth_it")}
    assert pricing.route(df, 1_000_000).where("id = 'a'").first().sketch_decision == "certifiable_over_budget"


def test_index_crosses_one(spark):
    gap = spark.createDataFrame([(4.4e-5,)], "gap double")
    low, high = (pricing.best_index(gap, m).first().best_index for m in (1_000_000, 40_000_000))
    assert low < 1 < high


def test_count_min_bounds_and_merges(spark, sf):
    e = fx.diffuse(spark, sf)
    exact = {(r.src, r.dst): r.weight for r in e.groupBy("src", "dst").sum("weight").toDF("src", "dst", "weight").collect()}
    keys = e.select("src", "dst").distinct()
    errors = []
    for width in (64, 4096):
        got = sketches.estimate(keys, sketches.count_min(e, width, 4), width, 4).collect()
        assert all(r.estimated_weight >= exact[r.src, r.dst] for r in got)
        errors.append(sum(r.estimated_weight - exact[r.src, r.dst] for r in got))
    assert errors[1] <= errors[0]
    halves = [sketches.count_min(e.where(f"src % 2 = {i}"), 256, 3) for i in (0, 1)]
    assert {tuple(r) for r in sketches.merge_count_min(*halves).collect()} == {tuple(r) for r in sketches.count_min(e, 256, 3).collect()}


@pytest.mark.parametrize("capacity", [1, 8, 64])
def test_space_saving_bounds(spark, capacity):
    rng = random.Random(capacity)
    rows = [(rng.randrange(40), 0, rng.randrange(1, 30)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "src long, dst long, weight long").repartition(5)
    exact = {}
    for s, _, w in rows:
        exact[s] = exact.get(s, 0) + w
    total, got = sum(exact.values()), sketches.space_saving(df, capacity).collect()
    assert len(got) <= capacity
    for r in got:
        assert exact[r.src] <= r["count"] + 1e-9 and r["count"] - r.error <= exact[r.src] + 1e-9 and r.error <= total / capacity + 1e-9
    assert {s for s, w in exact.items() if w > total / capacity} <= {r.src for r in got}


def test_weaker_retention_bound_fails(spark):
    """With one counter, a pair of weight 3 of 4 can be lost although it is above W / 2: only W / c is promised."""
    kept = sketches.space_saving(spark.createDataFrame([(1, 0, 3), (2, 0, 1)], "src long, dst long, weight long"), 1).collect()
    assert len(kept) == 1 and kept[0]["count"] == 4.0


def test_dyadic_finds_heavy_pairs(spark):
    rng = random.Random(4)
    rows = [(7, 9, 5000), (100, 3, 4000), (512, 77, 3000)] + [(rng.randrange(1000), rng.randrange(1000), rng.randrange(1, 20)) for _ in range(500)]
    df = spark.createDataFrame(rows, "src long, dst long, weight long")
    keys, bits, dst_bits = sketches.edge_keys(df)
    found = sketches.unpack(sketches.dyadic_heavy_hitters(sketches.dyadic_count_min(keys, bits, 1024, 4), bits, 3, 128, 1024, 4), dst_bits)
    assert {(r.src, r.dst) for r in found.collect()} == {(7, 9), (100, 3), (512, 77)}
    with pytest.raises(ValueError, match="63 fit"):
        sketches.edge_keys(df, (40, 40))


def test_identifiability(spark):
    skew = [(i, 0, w) for i, w in enumerate([10000, 9000, 8000, 7000, 6000] + [1] * 200)]
    ties = [(i, 0, 40) for i in range(100)]
    for rows, k, want in ((skew, 5, (1.0, 1.0, 5, 1.0)), (ties, 20, (0.0, 1.0, 0, None))):
        df = spark.createDataFrame(rows, "src long, dst long, weight long")
        take = range(k) if rows is skew else range(100 - k, 100)
        top = spark.createDataFrame([(i + 1, s, 0) for i, s in enumerate(take)], "rank long, src long, dst long")
        r = sketches.identifiability_report(df, top, k).first()
        assert (r.strict_recall, r.tie_aware_recall, r.identifiable_core_size, r.identifiable_recall) == want


@pytest.mark.parametrize("parts", [1, 9, 100])
def test_capacity_holds_over_many_tasks(spark, parts):
    """Dealt by pair beforehand, so that every partition has a summary of its own: one of `capacity` rows is left, with its promises."""
    rows = [(i % 50, i % 7, 1 + (i % 50 == 3) * 40) for i in range(2000)]
    df = spark.createDataFrame(rows, "src long, dst long, weight long").repartition(parts, "src", "dst")
    exact = {}
    for s, d, w in rows:
        exact[s, d] = exact.get((s, d), 0) + w
    total, got = sum(exact.values()), sketches.space_saving(df, 16).collect()
    assert len(got) <= 16
    assert all(exact[r.src, r.dst] <= r["count"] + 1e-9 and r["count"] - r.error <= exact[r.src, r.dst] + 1e-9 and r.error <= total / 16 + 1e-9 for r in got)
    assert {p for p, w in exact.items() if w > total / 16} <= {(r.src, r.dst) for r in got}
    assert {(r.src, r.dst): r.weight for r in sketches.heavy_hitters(df, 16).collect()} == {p: w for p, w in exact.items() if w > total / 16}


def test_prices_follow_their_gap(spark):
    """Equal gaps have equal prices, whatever the partitioning; rows keep their own."""
    rows = [(i, [1e-2, 1e-3, 0.0, float("nan"), 5e-5][i % 5]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, gap double")
    one = {r.id: (r.feasible, r.width, r.capacity) for r in pricing.price(df).collect()}
    two = {r.id: (r.feasible, r.width, r.capacity) for r in pricing.price(df.repartition(7, "id")).collect()}
    assert one == two and len(one) == 50 and all(one[i] == one[i % 5] for i in range(50))
    assert len({one[i] for i in (0, 1, 4)}) == 3 and not one[2][0] and not one[3][0]


def test_price_of_a_tiny_gap_is_the_least(spark):
    """Around an optimum of some ten thousand capacities, against every one of them."""
    import math

    gap = 2e-4
    r = pricing.price(spark.createDataFrame([(gap,)], "gap double")).first()
    best = None
    for c in range(max(1, r.capacity - 3000), r.capacity + 3000):
        if gap / 2 > 1 / (c + 1):
            w = math.ceil(math.e / (gap / 2 - 1 / (c + 1)))
            for w in (w, w + 1):
                k = max(math.ceil(1 / (gap / 2 - math.e / w)) - 1, 1) if gap / 2 > math.e / w else None
                if k:
                    best = min(best or (1e99,), (40 * w + 32 * k, w, k))
    assert (r.total_bytes, r.width, r.capacity) == best


def test_bounds_by_name(spark):
    bounds = spark.createDataFrame([("a", 0.2), ("a", 0.1), ("b_edges", 0.3), ("c", -5.0)], "source string, bound double")
    rows = spark.createDataFrame([("a",), ("a_edges",), ("b_edges",), ("b",), ("c",), ("d",)], "source string")
    assert {r.source: r.gap for r in pricing.with_bounds(rows, bounds).collect()} == {"a": 0.1, "a_edges": 0.1, "b_edges": 0.3, "b": 0.0, "c": 0.0, "d": 0.0}
