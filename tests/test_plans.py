import json

import pytest
from pyspark.sql import functions as F

from flowsieve import cli
from flowsieve.operators import pairs as P
from flowsieve.plans import sweeps
from flowsieve.sources import edges as E, fixtures as fx, synthetic


def test_sweeps(spark):
    e = E.normalise(synthetic.make_edges(spark, 3000, 64, 64, "hotspot", 43)).cache()
    rows = sweeps.width_sweep(e, (64, 4096), 3, 256).orderBy("width").collect()
    assert rows[0].median_relative_error >= rows[1].median_relative_error and rows[1].n_edges == 3000
    rows = sweeps.capacity_sweep(e, (32, 4096), 1024, 3).orderBy("capacity").collect()
    assert rows[0].candidate_recall <= rows[1].candidate_recall == 1.0
    row = sweeps.dyadic_comparison(e, 5, 512, 3, 64, 512).first()
    assert row.dyadic_topk_recall >= 0.8 and row.tracker_candidate_recall >= row.tracker_topk_recall
    assert sweeps.phase_points(e, (512,), (64, 4096), 5).count() == 2


def test_certify_and_select(spark, sf):
    e = fx.events(spark, sf)
    out = sweeps.certify(e, "events", 50, 5)
    assert {k: v.count() for k, v in out.items()}["certificates"] == 6
    assert out["prices"].where(F.col("feasible") != (F.col("gap") > 0)).count() == 0
    assert sweeps.select_and_certify(e, 500).first().decision in ("certified_safe", "not_certified")


def test_command_line(spark, tmp_path, capsys):
    cli.main(["synth", "--out", str(tmp_path / "e.parquet"), "--edges", "500"], spark)
    cli.main(["run", "--input", str(tmp_path / "e.parquet"), "--out-prefix", str(tmp_path / "r"), "--top-k", "5"], spark)
    assert spark.read.option("header", True).csv(str(tmp_path / "r_top_edges")).count() == 5
    cli.main(["sweep", "--kind", "capacity", "--edges", "2000"], spark)
    assert capsys.readouterr().out.count("candidate_recall") == 5


def test_drivers(spark, tmp_path):
    e = E.normalise(synthetic.make_edges(spark, 3000, 64, 64, "hotspot", 43)).cache()
    named = {"hotspot_edges": e, "other": E.normalise(synthetic.make_edges(spark, 2000, 64, 64, "uniform", 5))}
    rows = {r.source: r for r in sweeps.identifiable_recall(named, 5, 4096, 3, 4096).collect()}
    assert rows["hotspot_edges"].strict_recall == 1.0 and rows["other"].n_edges == 2000
    prices = spark.createDataFrame([("hotspot_edges", True, 8192, 4096, 1), ("other", False, 0, 0, 0)], "source string, feasible boolean, width long, capacity long, total_bytes long")
    (row,) = sweeps.priced_recall(named, prices, 5).collect()
    assert row.source == "hotspot_edges" and row.topk_recall == 1.0
    bounds = spark.createDataFrame([("hotspot", 0.01), ("hotspot", 0.02), ("other", -1.0)], "source string, bound double")
    routed = {r.source: r for r in sweeps.router(named, bounds, 1000, repeats=1).collect()}
    assert routed["hotspot_edges"].gap == 0.01 and routed["other"].gap == 0.0 and routed["other"].sketch_decision == "unidentifiable"
    smoke = sweeps.format_smoke(P.aggregate_pairs(e), str(tmp_path / "m")).collect()
    assert [r.matches for r in smoke] == [True, True] and smoke[0].nnz == smoke[1].nnz
    exact, advice, sweep = sweeps.trace_experiment(e, 1000, 5, 512, 3, (32, 4096), 1)
    assert {r.method: r.matches for r in exact.collect()} == {"sparse_direct": True, "pandas_groupby": True}
    one = advice.first()
    assert one.recommendation_matches == (one.recommended_exact_method == one.fastest_method) and sweep.count() == 2


def test_injected_bins_stand_out(spark):
    """Every scenario's bin ranks first; the medians beside it are of the other bins."""
    bins, rows = sweeps.anomaly_ranking(spark, n=20_000, labels=512)
    got = {r.scenario: r for r in rows.collect()}
    assert set(got) == set(synthetic.SCENARIOS) and all(r.anomaly_rank == 1 for r in got.values())
    weights = sorted(r.total_weight for r in bins.where("scenario = 'scan' and time_bin <> 17").collect())
    assert got["scan"].typical_total_weight_median == (weights[11] if len(weights) % 2 else (weights[len(weights) // 2 - 1] + weights[len(weights) // 2]) / 2)


@pytest.mark.parametrize("kind", ["identifiable", "priced", "router", "formula", "smoke", "trace", "dyadic", "select", "certify", "anomaly", "benchmark"])
def test_experiments_by_command_line(spark, tmp_path, capsys, kind):
    files = []
    if kind in ("formula", "smoke"):
        cli.main(["synth", "--out", str(tmp_path / "e.parquet"), "--edges", "300"], spark)
        files = ["--input", str(tmp_path / "e.parquet")]
    cli.main(["experiment", "--kind", kind, "--edges", "1500", "--labels", "64", "--window", "50", "--top-k", "5", "--out", str(tmp_path), *files], spark)
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert rows and all(isinstance(r, dict) for r in rows)
    if kind == "smoke":
        assert [r["matches"] for r in rows] == [True] * 4
