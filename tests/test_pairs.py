import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from flowsieve.functions.stats import entropy_bits, gini, gini_total
from flowsieve.operators import decisions, ordering, pairs as P, summary, timebins, windows

EDGES = "src long, dst long, weight long"


def edges(spark, rows):
    return spark.createDataFrame(rows, EDGES)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.integers(0, 50)), max_size=40))
def test_strategies_agree(spark, rows):
    want = {}
    for s, d, w in rows:
        want[s, d] = want.get((s, d), 0) + w
    for strategy in P.STRATEGIES:
        got = {(r.src, r.dst): r.weight for r in P.aggregate_pairs(edges(spark, rows), strategy=strategy).collect()}
        assert got == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 30), max_size=40))
def test_entropy_and_gini(spark, weights):
    df = spark.createDataFrame([(w,) for w in weights], "w long")
    total, n = sum(weights), len(weights)
    entropy = -sum(w / total * math.log2(w / total) for w in weights if w) if total else 0.0
    value = 2 * sum(i * w for i, w in enumerate(sorted(weights), 1)) / (n * total) - (n + 1) / n if total else 0.0
    assert df.agg(entropy_bits("w")).first()[0] == pytest.approx(entropy, abs=1e-9)
    assert gini_total(df, "w", 4).first()[0] == pytest.approx(value, abs=1e-9)
    grouped = gini(df.withColumn("g", F.lit(1)), "w", ["g"]).collect()
    assert (grouped[0]["gini"] if grouped else 0.0) == pytest.approx(value, abs=1e-9)


def test_empty_and_errors(spark):
    none = edges(spark, [])
    assert P.top_k_edges(P.aggregate_pairs(none), 5).columns == ["rank", "src", "dst", "weight"]
    assert summary.matrix_summary(P.aggregate_pairs(none)).first().asDict() | {} == summary.matrix_summary(P.aggregate_pairs(none)).first().asDict()
    assert summary.matrix_summary(P.aggregate_pairs(none)).first().nnz == 0
    row = decisions.early_features(none.withColumn("seq", F.lit(0).cast("long")), 5).first()
    assert row.observed_edges == 0 and row.edge_gini == 0 and row.top_edge_share == 0
    with pytest.raises(ValueError, match="axis"):
        P.strengths(none, "row")
    with pytest.raises(ValueError, match="strategy"):
        P.aggregate_pairs(none, strategy="magic")
    with pytest.raises(ValueError, match="positive"):
        decisions.early_features(none, 0)
    with pytest.raises(ValueError, match="value column"):
        decisions.early_features(none.drop("weight"), 5)
    with pytest.raises(ValueError, match="unknown src labels.*3"):
        P.with_labels(edges(spark, [(3, 1, 1)]), spark.createDataFrame([(1,)], "x long"))


def test_ties_have_an_order(spark):
    rows = [(s, d, 5) for s in range(3) for d in range(3)]
    got = [(r.src, r.dst) for r in P.top_k_edges(edges(spark, rows), 4).orderBy("rank").collect()]
    assert got == [(0, 0), (0, 1), (0, 2), (1, 0)]


def test_compare_finds_differences(spark):
    a, b = edges(spark, [(1, 1, 2), (1, 2, 3)]), edges(spark, [(1, 1, 2), (2, 2, 4)])
    row = P.compare(a, b).first()
    assert (row.unmatched, row.max_difference, row.equivalent) == (2, 4.0, False)
    assert P.same_rows(a, a) and not P.same_rows(a, b)


def test_sequence_is_dense(spark):
    df = ordering.with_sequence(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), ["k"], partitions=7)
    assert [r.seq for r in df.orderBy("k").collect()] == list(range(1000))


def test_windows_drop_the_rest_and_exact_k(spark):
    rows = [(i % 2, 0, i % 2 + 1, i) for i in range(25)]
    df = spark.createDataFrame(rows, EDGES + ", seq long")
    both = {m: windows.window_statistics(df, 10, 2, m).orderBy("window").collect() for m in ("kth", "zero")}
    assert [r.window for r in both["kth"]] == [0, 1]
    assert both["kth"][0].topk_gap_share == pytest.approx(5 / 15) and both["zero"][0].topk_gap_share == 0.0
    assert windows.window_statistics(df, 10, 5).first().topk_gap_share == 0.0
    assert windows.window_statistics(df, 100, 2).count() == 0
    with pytest.raises(ValueError):
        windows.windowed(df, 0)


def test_singular_value_and_similarity(spark):
    import numpy as np

    m = np.array([[3.0, 0, 1], [0, 2, 0], [1, 1, 4]])
    rows = [(i, j, float(m[i, j])) for i in range(3) for j in range(3) if m[i, j]]
    df = spark.createDataFrame(rows, "src long, dst long, weight double")
    assert summary.top_singular_value(df, 24).first()[0] == pytest.approx(np.linalg.svd(m)[1][0], rel=1e-3)
    b = (m > 0).astype(int)
    row = summary.official_formula(df).first()
    assert (row.src_similarity_nnz, row.dst_similarity_nnz) == (np.count_nonzero(b @ b.T), np.count_nonzero(b.T @ b))


def test_anomaly_bin_ranks_first(spark):
    from flowsieve.sources import edges as E, synthetic

    for scenario in ("volume_spike", "hotspot"):
        raw = synthetic.make_anomaly_edges(spark, scenario, n=6000, labels=256, bins=12, bad_bin=7)
        scored = timebins.anomaly_ranks(timebins.anomaly_scores(timebins.time_bin_summary(E.normalise(raw))))
        assert scored.where("rank = 1").first().time_bin == 7


def test_prefix_certificate_decides(spark):
    rows = [(i, 0, w, i) for i, w in enumerate([10000, 9000, 8000, 7000, 6000] + [1] * 50)]
    df = spark.createDataFrame(rows, EDGES + ", seq long")
    assert decisions.prefix_certificate(df, 100, 5).first().decision == "certified_safe"
    ties = spark.createDataFrame([(i, 0, 40, i) for i in range(50)], EDGES + ", seq long")
    row = decisions.prefix_certificate(ties, 100, 5).first()
    assert (row.decision, row.reason, row.width_min) == ("not_certified", "no gap after rank k", float("inf"))


def test_gini_of_groups_in_ranges(spark):
    """A group cut by ranges has the same coefficient; null is a group."""
    rows = [("hot", float(i * i % 97)) for i in range(400)] + [("b", 1.0), ("b", 5.0)] + [(None, float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, w double").repartition(5)
    whole = {r.g: round(r.gini, 9) for r in gini(df, "w", ["g"]).collect()}
    assert {r.g: round(r.gini, 9) for r in gini(df, "w", ["g"], ranges=7).collect()} == whole and len(whole) == 3


def test_salt_is_a_function_of_the_row(spark):
    df = spark.createDataFrame([(1, 2, i % 5 + 1, i) for i in range(500)] + [(2, 3, 7, 500)], "src long, dst long, weight long, seq long")
    assert P.same_rows(P.aggregate_pairs(df), P.aggregate_pairs(df.repartition(7), strategy="preaggregate"))


def test_window_differences(spark):
    left = spark.createDataFrame([(i, i % 3, i % 2) for i in range(20)], "seq long, src long, dst long")
    right = left.where("seq <> 13").unionByName(spark.createDataFrame([(13, 9, 9), (13, 9, 9)], left.schema))
    rows = {r.window: (r.left_rows, r.right_rows, r.unmatched, r["equal"]) for r in P.window_differences(left, right, 8).collect()}
    assert rows == {0: (8, 8, 0, True), 1: (8, 9, 3, False), 2: (4, 4, 0, True)}


def test_similarity_of_hubs(spark, monkeypatch):
    """Pairs and bitmaps count alike: a hub of all labels, small neighbours, and more labels than a bitmap holds."""
    rows = [(i, 1000 + i % 70) for i in range(300)] + [(i, 5) for i in range(0, 300, 2)] + [(500, 6)]
    pairs = spark.createDataFrame(rows, "src long, dst long").distinct().withColumn("weight", F.lit(1))
    near = {}
    for a, v in set(rows):
        near.setdefault(v, set()).add(a)
    want = len({(a, b) for s in near.values() for a in s for b in s})
    got = []
    for words, labels in ((512, 32_768), (1e-9, 32_768), (1e-9, 64)):
        monkeypatch.setattr(summary, "_WORDS", words)
        monkeypatch.setattr(summary, "_LABELS", labels)
        got.append(summary.similarity_cells(pairs, "src").first()[0])
    assert got == [want] * 3
