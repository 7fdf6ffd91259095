"""The engine's queries by name, each with the DuckDB SQL that gives the same rows where SQL can.

Doubles are rounded on both sides, because engines add in different orders."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.stats import gini
from ..operators import conformal, decisions, pairs as P, pricing, sketches, summary, timebins, windows
from ..operators.ordering import durable, shared_folder
from ..sources import edges as E, fixtures as fx, pcap, sinks, synthetic
from ..sources.fixtures import SQL
from . import sweeps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
K = 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Finite doubles rounded; infinities stay."""
    return df.select(*(F.when(F.abs(c) < float("inf"), F.round(c, digits)).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def with_ctes(*names: str, pairs: str | None = None) -> str:
    parts = [f"e{n} AS ({SQL[n]})" for n in names]
    if pairs:
        parts.append(f"p AS (SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM e{pairs} GROUP BY src, dst)")
    return "WITH " + ", ".join(parts)


PAIRS_A = with_ctes("a", pairs="a")
R = lambda x, n=6: f"round({x}, {n})"
ENTROPY = "coalesce(greatest(log2(sum({w})) - sum({w} * log2({w})) / sum({w}), 0.0), 0.0)"


def entropy(w: str) -> str:
    return ENTROPY.format(w=f"CAST({w} AS DOUBLE)")


def gini_sql(rows: str, w: str = "weight", by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    cols = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"(SELECT {cols}2 * sum(i * w) / (count(*) * sum(w)) - (count(*) + 1.0) / count(*) AS gini FROM (SELECT {cols}CAST({w} AS DOUBLE) AS w, row_number() OVER ({part}ORDER BY {w}) AS i FROM {rows}){group})"


# Pairs


@query(f"{PAIRS_A} SELECT row_number() OVER (ORDER BY weight DESC, src, dst) AS rank, src, dst, weight FROM p ORDER BY weight DESC, src, dst LIMIT {K}")
def top_k_edges(spark, sf):
    return P.top_k_edges(P.aggregate_pairs(fx.diffuse(spark, sf)), K)


@query(f"{PAIRS_A} SELECT src, dst, weight FROM p")
def pair_aggregate(spark, sf):
    return P.aggregate_pairs(fx.diffuse(spark, sf))


@query(f"{PAIRS_A} SELECT src, dst, weight FROM p")
def pair_aggregate_salted(spark, sf):
    return P.aggregate_pairs(fx.diffuse(spark, sf), strategy="preaggregate")


@query(f"{PAIRS_A} SELECT src, dst, weight FROM p")
def pair_aggregate_sorted(spark, sf):
    return P.aggregate_pairs(fx.diffuse(spark, sf), strategy="sort")


_COMPARE = """SELECT count(l.weight) AS left_nnz, count(r.weight) AS right_nnz, count(*) FILTER (l.weight IS NULL OR r.weight IS NULL) AS unmatched, coalesce(max(abs(CAST(coalesce(l.weight, 0) - coalesce(r.weight, 0) AS DOUBLE))), 0.0) AS max_difference,
count(*) FILTER (l.weight IS NULL OR r.weight IS NULL) = 0 AND coalesce(max(abs(coalesce(l.weight, 0) - coalesce(r.weight, 0))), 0) < 1e-9 AS equivalent FROM l FULL JOIN r ON l.src = r.src AND l.dst = r.dst"""


@query(f"{PAIRS_A}, l AS (SELECT * FROM p), r AS (SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM ea GROUP BY src, dst) {_COMPARE}")
def builders_equal(spark, sf):
    e = fx.diffuse(spark, sf)
    return P.compare(P.aggregate_pairs(e), P.aggregate_pairs(e, strategy="preaggregate"))


@query(f"{PAIRS_A}, l AS (SELECT * FROM p), r AS (SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM ea WHERE weight % 11 <> 3 GROUP BY src, dst) {_COMPARE}")
def builders_differ(spark, sf):
    """A table against itself without some records."""
    e = fx.diffuse(spark, sf)
    return P.compare(P.aggregate_pairs(e), P.aggregate_pairs(e.where("weight % 11 <> 3"), strategy="sort"))


@query(f"""{with_ctes('d')}, l AS (SELECT seq // 1000 AS "window", src, dst, count(*) AS n FROM ed GROUP BY 1, 2, 3), r AS (SELECT seq // 1000 AS "window", src, dst, count(*) AS n FROM ed WHERE seq % 500 <> 7 OR seq < 1000 GROUP BY 1, 2, 3)
SELECT coalesce(l."window", r."window") AS "window", CAST(sum(coalesce(l.n, 0)) AS BIGINT) AS left_rows, CAST(sum(coalesce(r.n, 0)) AS BIGINT) AS right_rows, CAST(sum(abs(coalesce(l.n, 0) - coalesce(r.n, 0))) AS BIGINT) AS unmatched, sum(abs(coalesce(l.n, 0) - coalesce(r.n, 0))) = 0 AS equal
FROM l FULL JOIN r ON l."window" = r."window" AND l.src = r.src AND l.dst = r.dst GROUP BY 1""")
def window_differences(spark, sf):
    e = fx.events(spark, sf)
    return P.window_differences(e, e.where("seq % 500 <> 7 or seq < 1000"), 1000)


@query(f"{PAIRS_A} SELECT src AS label, CAST(sum(weight) AS BIGINT) AS strength, count(*) AS degree FROM p GROUP BY src")
def src_strength(spark, sf):
    return P.strength_distribution(P.aggregate_pairs(fx.diffuse(spark, sf)), "src")


@query(f"{PAIRS_A} SELECT dst AS label, CAST(sum(weight) AS BIGINT) AS strength, count(*) AS degree FROM p GROUP BY dst")
def dst_strength(spark, sf):
    return P.strength_distribution(P.aggregate_pairs(fx.diffuse(spark, sf)), "dst")


@query(f"""{with_ctes("d", pairs="d")}
SELECT 'src' AS axis, CAST(src AS VARCHAR) AS label, CAST(sum(weight) AS BIGINT) AS strength, count(*) AS degree FROM p GROUP BY src
UNION ALL SELECT 'dst', dst, CAST(sum(weight) AS BIGINT), count(*) FROM p GROUP BY dst UNION ALL SELECT 'all', NULL, CAST(sum(weight) AS BIGINT), count(*) FROM p""")
def vertex_rollup(spark, sf):
    return P.vertex_rollup(P.aggregate_pairs(fx.events(spark, sf)))


@query(f"""{with_ctes("d", pairs="d")}, s AS (SELECT src, row_number() OVER (ORDER BY src) - 1 AS row FROM (SELECT DISTINCT src FROM p)),
t AS (SELECT dst, row_number() OVER (ORDER BY dst) - 1 AS col FROM (SELECT DISTINCT dst FROM p)) SELECT row, col, weight FROM p JOIN s USING (src) JOIN t USING (dst)""")
def matrix_codes(spark, sf):
    return P.coded_pairs(P.aggregate_pairs(fx.events(spark, sf)))


@query(f"{PAIRS_A} SELECT src, dst, weight FROM p WHERE src IN (SELECT s_suppkey FROM supplier) AND dst IN (SELECT p_partkey FROM part)")
def labelled_pairs(spark, sf):
    labels = fx.table(spark, sf, "supplier").select("s_suppkey"), fx.table(spark, sf, "part").select("p_partkey")
    return P.aggregate_pairs(P.with_labels(fx.diffuse(spark, sf), *labels))


# Scans and cleaning


@query("""WITH v AS (SELECT user_id AS src, event_type AS dst, CASE WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 11 = 0 THEN 'NaN' WHEN event_id % 13 = 0 THEN NULL ELSE CAST(CAST(round(value * 100) AS BIGINT) - 200 AS VARCHAR) END AS t FROM events)
SELECT src, dst, count(*) AS n, CAST(sum(CAST(t AS BIGINT)) AS BIGINT) AS weight FROM v WHERE src IS NOT NULL AND dst IS NOT NULL AND TRY_CAST(t AS BIGINT) > 0 GROUP BY src, dst""")
def coerced_edges(spark, sf):
    id_, cents = F.col("event_id"), (fx.cents("value") - 200).cast("string")
    text = F.when(id_ % 7 == 0, "n/a").when(id_ % 11 == 0, "NaN").when(id_ % 13 == 0, F.lit(None)).otherwise(cents)
    raw = fx.table(spark, sf, "events").select(F.col("user_id").alias("src"), F.col("event_type").alias("dst"), text.alias("bytes"))
    return E.normalise(raw).groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("weight").cast("long").alias("weight"))


@query("SELECT user_id AS src, event_type AS dst, CAST(count(*) AS DOUBLE) AS weight FROM events GROUP BY 1, 2")
def unweighted_pairs(spark, sf):
    raw = fx.table(spark, sf, "events").select(F.col("user_id").alias("src"), F.col("event_type").alias("dst"))
    return P.aggregate_pairs(E.normalise(raw))


@query(f"""{with_ctes("d")}, f AS (SELECT seq, CAST(src AS VARCHAR) AS s, CASE WHEN seq % 10 = 3 THEN NULL ELSE dst END AS d, weight FROM ed),
s AS (SELECT s, row_number() OVER (ORDER BY min(seq)) - 1 AS c FROM f GROUP BY s), t AS (SELECT d, row_number() OVER (ORDER BY min(seq)) - 1 AS c FROM f WHERE d IS NOT NULL GROUP BY d)
SELECT f.seq, s.c AS src, coalesce(t.c, -1) AS dst, CAST(weight AS DOUBLE) AS weight FROM f JOIN s ON f.s = s.s LEFT JOIN t ON f.d = t.d WHERE weight > 0""")
def flow_adapter(spark, sf):
    e = fx.events(spark, sf)
    flows = e.select(F.col("seq").alias("at"), F.col("src").cast("string").alias("SrcAddr"), F.when(F.col("seq") % 10 == 3, F.lit(None)).otherwise(F.col("dst")).alias("DstAddr"), F.col("weight").alias("TotBytes"))
    return E.adapt_flows(flows, ["at"])


@query(f"{with_ctes('a')} SELECT count(*) AS records, count(DISTINCT src) AS unique_sources, count(DISTINCT dst) AS unique_destinations, count(DISTINCT (src, dst)) AS unique_pairs, min(weight) AS min_weight, max(weight) AS max_weight, CAST(sum(weight) AS BIGINT) AS total_weight FROM ea")
def trace_statistics(spark, sf):
    return summary.trace_statistics(fx.diffuse(spark, sf))


# Summaries


def _summary_sql(name: str) -> str:
    return f"""{with_ctes(name, pairs=name)}, s AS (SELECT src, sum(weight) AS w, count(*) AS n FROM p GROUP BY src), t AS (SELECT dst, sum(weight) AS w, count(*) AS n FROM p GROUP BY dst)
SELECT c.*, a.*, b.*, {R("g.gini")} AS edge_gini, {R("nnz / CAST(n_source * n_destination AS DOUBLE)")} AS density FROM
(SELECT count(*) AS nnz, CAST(sum(weight) AS DOUBLE) AS total_weight, CAST(max(weight) AS DOUBLE) AS max_edge FROM p) c,
(SELECT count(*) AS n_source, CAST(max(w) AS DOUBLE) AS max_source_strength, max(n) AS max_source_degree, {R(entropy("w"))} AS source_entropy_bits FROM s) a,
(SELECT count(*) AS n_destination, CAST(max(w) AS DOUBLE) AS max_destination_strength, max(n) AS max_destination_degree, {R(entropy("w"))} AS destination_entropy_bits FROM t) b,
{gini_sql("p")} g"""


@query(_summary_sql("a"))
def matrix_summary(spark, sf):
    return rounded(summary.matrix_summary(P.aggregate_pairs(fx.diffuse(spark, sf))))


@query(_summary_sql("c"))
def matrix_summary_dense(spark, sf):
    return rounded(summary.matrix_summary(P.aggregate_pairs(fx.dense(spark, sf))))


@query(f"{PAIRS_A} SELECT {R('sqrt(sum(CAST(weight AS DOUBLE) * CAST(weight AS DOUBLE)))', 2)} AS frobenius_norm FROM p")
def frobenius_norm(spark, sf):
    return rounded(summary.frobenius_norm(P.aggregate_pairs(fx.diffuse(spark, sf))), 2)


def _power_sql(rounds: int) -> str:
    out = [with_ctes("c", pairs="c"), "x0 AS (SELECT dst, 1.0 / sqrt(count(*) OVER ()) AS x FROM (SELECT DISTINCT dst FROM p))"]
    for i in range(rounds):
        out.append(f"y{i} AS MATERIALIZED (SELECT src, sum(weight * x) AS y FROM p JOIN x{i} USING (dst) GROUP BY src)")
        out.append(f"z{i} AS MATERIALIZED (SELECT dst, sum(weight * y) AS z FROM p JOIN y{i} USING (src) GROUP BY dst)")
        out.append(f"x{i + 1} AS MATERIALIZED (SELECT dst, z / sqrt((SELECT sum(z * z) FROM z{i})) AS x FROM z{i})")
    return ", ".join(out) + f" SELECT round(sqrt(sum(y * y))) AS top_singular_value FROM y{rounds - 1}"


@query(_power_sql(8))
def top_singular_value(spark, sf):
    return summary.top_singular_value(P.aggregate_pairs(fx.dense(spark, sf)), 8).select(F.round("top_singular_value").alias("top_singular_value"))


@query(f"""{with_ctes("d", pairs="d")} SELECT a.*, b.*, c.* FROM
(SELECT CAST(sum(weight) AS DOUBLE) AS total_weight, count(*) AS activity_nnz, count(DISTINCT src) AS n_source, count(DISTINCT dst) AS n_destination FROM p) a,
(SELECT count(*) AS src_similarity_nnz FROM (SELECT DISTINCT x.src, y.src AS o FROM p x JOIN p y ON x.dst = y.dst)) b,
(SELECT count(*) AS dst_similarity_nnz FROM (SELECT DISTINCT x.dst, y.dst AS o FROM p x JOIN p y ON x.src = y.src)) c""")
def official_formula(spark, sf):
    return summary.official_formula(P.aggregate_pairs(fx.events(spark, sf)))


# Windows, prefixes


def _window_sql(name: str, size: int, exact_k: str = "kth") -> str:
    alone = "k.kth" if exact_k == "kth" else "0"
    return f"""w AS (SELECT *, seq // {size} AS win FROM e{name} WHERE seq // {size} < (SELECT (max(seq) + 1) // {size} FROM e{name})),
wp AS (SELECT win, src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM w GROUP BY 1, 2, 3),
k AS (SELECT win, max(CASE WHEN r = {K} THEN weight END) AS kth, max(CASE WHEN r = {K + 1} THEN weight END) AS nxt FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY weight DESC, src, dst) AS r FROM wp) GROUP BY win),
t AS (SELECT win, count(*) AS n, CAST(sum(weight) AS DOUBLE) AS tw FROM wp GROUP BY win),
ws AS (SELECT t.win AS "window", CAST({size} AS BIGINT) AS window_edges, n AS unique_pairs, {R(f"1 - n / {size}.0")} AS duplication_rate, tw AS total_weight,
{R(f"CASE WHEN k.kth IS NULL THEN 0.0 WHEN k.nxt IS NULL THEN {alone} / tw ELSE (k.kth - k.nxt) / tw END", 9)} AS topk_gap_share, {R("coalesce(k.kth, 0) / tw", 9)} AS kth_weight_share FROM t JOIN k USING (win))"""


def _fine(df: DataFrame, *fine: str) -> DataFrame:
    cols = [F.round(c, 9 if c in fine else 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return df.select(*cols)


@query(f"{with_ctes('d')}, {_window_sql('d', 700)} SELECT * FROM ws")
def window_statistics(spark, sf):
    return _fine(windows.window_statistics(fx.events(spark, sf), 700, K), "topk_gap_share", "kth_weight_share")


@query(f"{with_ctes('aseq')}, {_window_sql('aseq', 5000)} SELECT * FROM ws")
def window_statistics_sequenced(spark, sf):
    return _fine(windows.window_statistics(fx.diffuse_sequenced(spark, sf), 5000, K), "topk_gap_share", "kth_weight_share")


def _shape_sql(x: str) -> str:
    return f"CASE WHEN {x}.duplication_rate >= 0.55 OR {x}.edge_gini >= 0.82 OR {x}.top_edge_share >= 0.01 OR greatest({x}.top_source_share, {x}.top_destination_share) >= 0.05 THEN 'concentrated' WHEN {x}.duplication_rate <= 0.2 AND {x}.nnz_growth_rate >= 0.8 THEN 'diffuse' ELSE 'mixed' END"


_METHOD_SQL = "CASE WHEN shape = 'concentrated' THEN 'pandas_groupby' ELSE 'sparse_direct' END AS recommended_exact_method, CASE shape WHEN 'concentrated' THEN 'viable_for_concentrated_heavy_hitters' WHEN 'diffuse' THEN 'not_recommended_for_topk_without_large_candidates' ELSE 'profile_before_using_for_topk' END AS streaming_heavy_hitter_advice"


def _stability_sql(name: str, size: int, head: int) -> str:
    return f"""{with_ctes(name)}, {_window_sql(name, size, "zero")},
h AS (SELECT win, src, dst, sum(weight) AS weight, count(*) AS n FROM w WHERE seq - win * {size} < {head} GROUP BY 1, 2, 3),
f AS (SELECT h.win AS "window", CAST(sum(n) AS BIGINT) AS observed_edges, count(*) AS unique_pairs, 1 - count(*) / CAST(sum(n) AS DOUBLE) AS duplication_rate, count(*) / CAST(sum(n) AS DOUBLE) AS nnz_growth_rate, max(gini) AS edge_gini,
max(weight) / CAST(sum(weight) AS DOUBLE) AS top_edge_share, max(ms) / CAST(sum(weight) AS DOUBLE) AS top_source_share, max(md) / CAST(sum(weight) AS DOUBLE) AS top_destination_share
FROM h JOIN (SELECT win, max(s) AS ms FROM (SELECT win, src, sum(weight) AS s FROM h GROUP BY 1, 2) GROUP BY 1) USING (win) JOIN (SELECT win, max(s) AS md FROM (SELECT win, dst, sum(weight) AS s FROM h GROUP BY 1, 2) GROUP BY 1) USING (win)
JOIN {gini_sql("h", by="win")} USING (win) GROUP BY h.win), g AS (SELECT *, {_shape_sql("f")} AS shape FROM f), m AS (SELECT *, {_METHOD_SQL} FROM g)
SELECT "window", m.observed_edges, m.unique_pairs, {", ".join(f"{R('m.' + c)} AS {c}" for c in ("duplication_rate", "nnz_growth_rate", "edge_gini", "top_edge_share", "top_source_share", "top_destination_share"))},
shape, recommended_exact_method, streaming_heavy_hitter_advice, ws.topk_gap_share, min(recommended_exact_method) OVER () = max(recommended_exact_method) OVER () AS all_agree FROM m JOIN ws USING ("window")"""


@query(_stability_sql("d", 1000, 300))
def window_stability(spark, sf):
    return _fine(decisions.window_stability(fx.events(spark, sf), 1000, 300, K), "topk_gap_share")


_SETS = {"a": ("diffuse", "aseq", fx.diffuse_sequenced), "d": ("events", "d", fx.events)}
_HEAD = 5000


def _features_sql(name: str, label: str) -> str:
    q = f"q{name}"
    return f"""{q} AS (SELECT src, dst, sum(weight) AS weight, count(*) AS n FROM e{name} WHERE seq < {_HEAD} GROUP BY 1, 2),
f{name} AS (SELECT '{label}' AS source, CAST(sum(n) AS BIGINT) AS observed_edges, count(*) AS unique_pairs, (SELECT count(DISTINCT src) FROM {q}) AS unique_sources, (SELECT count(DISTINCT dst) FROM {q}) AS unique_destinations,
1 - count(*) / CAST(sum(n) AS DOUBLE) AS duplication_rate, count(*) / CAST(sum(n) AS DOUBLE) AS nnz_growth_rate,
(SELECT {entropy("s")} FROM (SELECT sum(weight) AS s FROM {q} GROUP BY src)) AS source_entropy_bits, (SELECT {entropy("s")} FROM (SELECT sum(weight) AS s FROM {q} GROUP BY dst)) AS destination_entropy_bits,
{entropy("weight")} AS edge_entropy_bits, (SELECT gini FROM {gini_sql(q)}) AS edge_gini, max(weight) / CAST(sum(weight) AS DOUBLE) AS top_edge_share,
(SELECT max(s) FROM (SELECT sum(weight) AS s FROM {q} GROUP BY src)) / CAST(sum(weight) AS DOUBLE) AS top_source_share, (SELECT max(s) FROM (SELECT sum(weight) AS s FROM {q} GROUP BY dst)) / CAST(sum(weight) AS DOUBLE) AS top_destination_share FROM {q})"""


_FEATURES = ("duplication_rate", "nnz_growth_rate", "source_entropy_bits", "destination_entropy_bits", "edge_entropy_bits", "edge_gini", "top_edge_share", "top_source_share", "top_destination_share")


@query(f"""{with_ctes("aseq", "d")}, {_features_sql("aseq", "diffuse")}, {_features_sql("d", "events")}, u AS (SELECT * FROM faseq UNION ALL SELECT * FROM fd), g AS (SELECT *, {_shape_sql("u")} AS shape FROM u)
SELECT source, observed_edges, unique_pairs, unique_sources, unique_destinations, {", ".join(f"{R(c)} AS {c}" for c in _FEATURES)}, shape, {_METHOD_SQL} FROM g""")
def early_features(spark, sf):
    rows = [decisions.recommend(decisions.early_features(make(spark, sf), _HEAD)).select(F.lit(label).alias("source"), "*") for label, _, make in _SETS.values()]
    return rounded(rows[0].unionByName(rows[1]))


def _certificate_sql(name: str, label: str, k: int = K, width: int = 8192, capacity: int = 512) -> str:
    return f"""SELECT '{label}' AS source, {k} AS top_k, {R("tk / tw", 9)} AS topk_weight_share, {R("kth / tw", 9)} AS kth_weight_share, {R("gap", 9)} AS topk_gap_share, c_min, {R("gap / 2", 9)} AS epsilon_required, width_min, {R("gap - noise", 9)} AS margin, CAST({width * 5 * 8} AS BIGINT) AS sketch_bytes, reason,
CASE WHEN reason = 'ok' THEN 'certified_safe' ELSE 'not_certified' END AS decision FROM (SELECT *, CASE WHEN tk <= 0 THEN 'no weight in the top k' WHEN gap <= 0 THEN 'no gap after rank k' WHEN c_min > {capacity} THEN 'capacity too small' WHEN width_min > {width} THEN 'width too small' WHEN gap - noise <= 0 THEN 'joint error too large' ELSE 'ok' END AS reason
FROM (SELECT *, CASE WHEN gap > 0 THEN ceil(exp(1.0) / (gap / 2)) ELSE CAST('inf' AS DOUBLE) END AS width_min, greatest(ceil(tw / kth) - 1, 0) AS c_min, 2 * (exp(1.0) / {width} + 1.0 / {capacity + 1}) AS noise
FROM (SELECT *, (kth - nxt) / tw AS gap FROM (SELECT CAST(sum(weight) AS DOUBLE) AS tw, CAST(sum(CASE WHEN r <= {k} THEN weight END) AS DOUBLE) AS tk, CAST(max(CASE WHEN r = {k} THEN weight END) AS DOUBLE) AS kth, CAST(max(CASE WHEN r = {k + 1} THEN weight END) AS DOUBLE) AS nxt
FROM (SELECT *, row_number() OVER (ORDER BY weight DESC, src, dst) AS r FROM (SELECT src, dst, sum(weight) AS weight FROM e{name} WHERE seq < {_HEAD} GROUP BY 1, 2))))))"""


@query(f"{with_ctes('aseq', 'd')} {_certificate_sql('aseq', 'diffuse')} UNION ALL {_certificate_sql('d', 'events')}")
def prefix_certificate(spark, sf):
    rows = [decisions.prefix_certificate(make(spark, sf), _HEAD, K).select(F.lit(label).alias("source"), "*") for label, _, make in _SETS.values()]
    return rounded(rows[0].unionByName(rows[1]), 9)


# Time bins

_BINS = f"""bp AS (SELECT time_bin, src, dst, sum(weight) AS weight, count(*) AS n FROM ed GROUP BY 1, 2, 3),
bs AS (SELECT time_bin, src, sum(weight) AS s FROM bp GROUP BY 1, 2), bd AS (SELECT time_bin, dst, sum(weight) AS s FROM bp GROUP BY 1, 2),
bsum AS (SELECT time_bin, CAST(sum(n) AS BIGINT) AS n_edges, count(*) AS nnz, CAST(sum(weight) AS DOUBLE) AS total_weight, max(se) AS source_entropy_bits, max(de) AS destination_entropy_bits, max(gini) AS edge_gini,
max(weight) / CAST(sum(weight) AS DOUBLE) AS top_edge_share, max(ms) / CAST(sum(weight) AS DOUBLE) AS top_source_share, max(md) / CAST(sum(weight) AS DOUBLE) AS top_destination_share, max(ns) AS unique_sources, max(nd) AS unique_destinations
FROM bp JOIN (SELECT time_bin, {entropy("s")} AS se, max(s) AS ms, count(*) AS ns FROM bs GROUP BY 1) USING (time_bin) JOIN (SELECT time_bin, {entropy("s")} AS de, max(s) AS md, count(*) AS nd FROM bd GROUP BY 1) USING (time_bin) JOIN {gini_sql("bp", by="time_bin")} USING (time_bin) GROUP BY time_bin)"""
_BIN_COLS = ("total_weight", "source_entropy_bits", "destination_entropy_bits", "edge_gini", "top_edge_share", "top_source_share", "top_destination_share")


@query(f"{with_ctes('d')}, {_BINS} SELECT time_bin, n_edges, nnz, unique_sources, unique_destinations, {', '.join(f'{R(c)} AS {c}' for c in _BIN_COLS)} FROM bsum")
def timebin_summary(spark, sf):
    return rounded(timebins.time_bin_summary(fx.events(spark, sf)))


def _anomaly_sql() -> str:
    z = timebins.Z_COLUMNS
    med = ", ".join(f"median(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in z)
    mad = ", ".join(f"median(abs({c} - m_{c})) AS d_{c}" for c in z)
    zs = ", ".join(f"({c} - m_{c}) / (CASE WHEN d_{c} > 0 THEN d_{c} WHEN s_{c} > 0 THEN s_{c} ELSE 1 END) AS z_{c}" for c in z)
    score = " + ".join(f"greatest(z_{c}, 0)" for c in timebins.SCORED)
    return f"{with_ctes('d')}, {_BINS}, m AS (SELECT {med} FROM bsum), q AS (SELECT * FROM bsum, m), d AS (SELECT {mad} FROM q), zz AS (SELECT time_bin, {zs} FROM q, d), sc AS (SELECT *, {score} AS s FROM zz) SELECT time_bin, {', '.join(f'round(z_{c}, 4) AS {c}_robust_z' for c in z)}, round(s, 4) AS anomaly_score, CAST(row_number() OVER (ORDER BY round(s, 4) DESC, time_bin) AS INTEGER) AS rank FROM sc"


@query(_anomaly_sql())
def timebin_anomaly(spark, sf):
    scored = timebins.anomaly_scores(timebins.time_bin_summary(fx.events(spark, sf)))
    scored = rounded(scored, 4)
    return timebins.anomaly_ranks(scored).select("time_bin", *(f"{c}_robust_z" for c in timebins.Z_COLUMNS), "anomaly_score", "rank")


# Conformal, prices, routing

_W = 250
_SCORES = f"{_window_sql('d', _W)}, sc AS (SELECT 'events' AS source, \"window\", topk_gap_share AS score FROM ws)"


def _scores(spark, sf):
    w = windows.window_statistics(fx.events(spark, sf), _W, K)
    return w.select(F.lit("events").alias("source"), "window", F.round("topk_gap_share", 9).alias("score"))


_ALPHAS = "(VALUES (CAST(0.05 AS DOUBLE)), (CAST(0.1 AS DOUBLE)), (CAST(0.2 AS DOUBLE))) al(alpha)"


def _bound_sql(rows: str) -> str:
    return f"(SELECT source, alpha, m, CAST(floor(alpha * (m + 1)) AS BIGINT) AS rank, coalesce(max(CASE WHEN r = floor(alpha * (m + 1)) THEN score END), CAST('-inf' AS DOUBLE)) AS bound FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score) AS r, count(*) OVER (PARTITION BY source) AS m FROM {rows}), {_ALPHAS} GROUP BY source, alpha, m)"


@query(f"{with_ctes('d')}, {_SCORES} SELECT b.*, width, capacity, {R('2 * (exp(1.0) / width + 1.0 / (capacity + 1))', 9)} AS threshold, bound > 2 * (exp(1.0) / width + 1.0 / (capacity + 1)) AS certified, {R('bound - 2 * (exp(1.0) / width + 1.0 / (capacity + 1))', 9)} AS margin FROM {_bound_sql('sc')} b, (VALUES (8192, 512), (16384, 5000)) v(width, capacity)")
def conformal_certificates(spark, sf):
    budgets = spark.createDataFrame([(8192, 512), (16384, 5000)], "width int, capacity int")
    return rounded(conformal.certificates(_scores(spark, sf), budgets, (0.05, 0.1, 0.2)), 9)


@query(f"""{with_ctes('d')}, {_SCORES}, o AS (SELECT *, row_number() OVER (ORDER BY "window") AS i, count(*) OVER () AS n FROM sc), cal AS (SELECT source, "window", score FROM o WHERE i <= n // 2), tst AS (SELECT source, score AS s FROM o WHERE i > n // 2)
SELECT source, alpha, m AS n_calibration, rank, bound, n_test, coverage, coverage >= 1.0 - alpha AS valid FROM (SELECT b.source, alpha, m, rank, bound, count(s) AS n_test, {R("avg(CASE WHEN s >= bound THEN 1.0 ELSE 0.0 END)", 9)} AS coverage FROM {_bound_sql('cal')} b JOIN tst USING (source) GROUP BY 1, 2, 3, 4, 5)""")
def conformal_coverage(spark, sf):
    return rounded(conformal.coverage(_scores(spark, sf)), 9)


_AW, _AK, _AWARM, _TARGET, _GAMMA = 20, 3, 10, 0.1, 0.05


def _adaptive_sql() -> str:
    """The fold as a recursion over windows: the scores so far are the head of one list, the level is the state."""
    rank = f"CAST(floor(least(greatest(alpha, {conformal.LEAST_LEVEL}), {conformal.MOST_LEVEL}) * (i + 1)) AS BIGINT)"
    ws = _window_sql("d", _AW).replace(f"WHEN r = {K} ", f"WHEN r = {_AK} ").replace(f"WHEN r = {K + 1} ", f"WHEN r = {_AK + 1} ")
    step = f"SELECT i, alpha, CASE WHEN {rank} >= 1 THEN list_sort(s[1:i])[{rank}] ELSE CAST('-inf' AS DOUBLE) END AS bound, s[i + 1] AS score FROM"
    return f"""{with_ctes('d').replace('WITH', 'WITH RECURSIVE', 1)}, {ws}, al AS MATERIALIZED (SELECT list(topk_gap_share ORDER BY "window") AS s FROM ws),
st AS (SELECT CAST({_AWARM} AS BIGINT) AS i, CAST({_TARGET} AS DOUBLE) AS alpha UNION ALL
SELECT i + 1, alpha + {_GAMMA} * ({_TARGET} - CASE WHEN score < bound THEN 1.0 ELSE 0.0 END) FROM ({step} st, al WHERE i + 1 < len(s)))
SELECT 'events' AS source, i AS "window", {R('alpha', 9)} AS alpha_t, bound, score, CASE WHEN score < bound THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS miscovered FROM ({step} st, al WHERE i < len(s))"""


@query(_adaptive_sql())
def adaptive_conformal(spark, sf):
    w = windows.window_statistics(fx.events(spark, sf), _AW, _AK)
    scores = w.select(F.lit("events").alias("source"), "window", F.round("topk_gap_share", 9).alias("score"))
    return rounded(conformal.adaptive(scores, _TARGET, _GAMMA, _AWARM), 9)


_RANKS = (1, 2, 5, 10, 20)
_GAPS = f"""{with_ctes("b", "c", pairs="c")}, gr AS (SELECT weight, lead(weight) OVER (ORDER BY weight DESC, src, dst) AS nxt, row_number() OVER (ORDER BY weight DESC, src, dst) AS r FROM p),
gb AS (SELECT weight, lead(weight) OVER (ORDER BY weight DESC, src, dst) AS nxt, row_number() OVER (ORDER BY weight DESC, src, dst) AS r FROM (SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM eb GROUP BY src, dst)),
g AS (SELECT 'rank_' || r || '_edges' AS source, CAST(weight - nxt AS DOUBLE) / (SELECT CAST(sum(weight) AS DOUBLE) FROM p) AS gap FROM gr WHERE r IN {_RANKS}
UNION ALL SELECT 'tied_' || min(r), CAST(0 AS DOUBLE) FROM gb WHERE weight = nxt)"""


def _gaps(spark, sf):
    """(source, gap) of the dense matrix after some ranks, and the first tie of the tied one, whose gap is 0."""
    def steps(edges):
        pairs = P.aggregate_pairs(edges)
        order = Window.partitionBy(F.lit(0)).orderBy(F.desc("weight"), "src", "dst")
        return pairs, pairs.select("weight", F.lead("weight").over(order).alias("next"), F.row_number().over(order).alias("r"))

    pairs, ranked = steps(fx.dense(spark, sf))
    total = pairs.agg(F.sum("weight").cast("double").alias("w"))
    some = ranked.where(F.col("r").isin(*_RANKS)).join(F.broadcast(total)).select(F.concat(F.lit("rank_"), F.col("r").cast("string"), F.lit("_edges")).alias("source"), ((F.col("weight") - F.col("next")).cast("double") / F.col("w")).alias("gap"))
    _, tied = steps(fx.tied(spark, sf))
    none = tied.where("weight = next").agg(F.min("r").alias("r")).select(F.concat(F.lit("tied_"), F.col("r").cast("string")).alias("source"), F.lit(0.0).alias("gap"))
    return durable(some.unionByName(none))


_PRICE = f"""w AS (SELECT source, gap, CAST(unnest(generate_series(CAST(0.98 * best AS BIGINT), CAST(1.02 * best AS BIGINT) + 2)) AS BIGINT) AS width FROM (SELECT *, (2 / gap) * (exp(1.0) + sqrt(exp(1.0) * 32 / 40.0)) AS best FROM g WHERE gap > 0)),
c AS (SELECT *, CAST(greatest(ceil(1 / (gap / 2 - exp(1.0) / width)) - 1, 1) AS BIGINT) AS capacity FROM w WHERE gap / 2 - exp(1.0) / width > 0),
b AS (SELECT * FROM (SELECT *, 40 * width + 32 * capacity AS total, row_number() OVER (PARTITION BY source ORDER BY 40 * width + 32 * capacity, width) AS r FROM c) WHERE r = 1),
pr AS (SELECT g.source, g.gap, g.gap > 0 AS feasible, coalesce(width, 0) AS width, coalesce(capacity, 0) AS capacity, coalesce(40 * width, 0) AS sketch_bytes, coalesce(32 * capacity, 0) AS candidate_bytes, coalesce(total, 0) AS total_bytes,
coalesce(g.gap - 2 * (exp(1.0) / width + 1.0 / (capacity + 1)), CAST('-inf' AS DOUBLE)) AS margin FROM g LEFT JOIN b ON g.source = b.source)"""


@query(f"{_GAPS}, {_PRICE} SELECT source, {R('gap', 12)} AS gap, feasible, width, capacity, sketch_bytes, candidate_bytes, total_bytes, {R('margin', 12)} AS margin FROM pr")
def budget_price(spark, sf):
    return rounded(pricing.price(_gaps(spark, sf)), 12)


@query(f"""{_GAPS} SELECT source, gap, {R("CASE WHEN gap > 0 THEN gap / least_error ELSE 0 END", 9)} AS best_index FROM g, (SELECT min(2 * (exp(1.0) / w + 1.0 / (c + 1))) AS least_error FROM (SELECT floor(i / 40.0 * 16000000 / 40) AS w, floor((1 - i / 40.0) * 16000000 / 32) AS c FROM generate_series(1, 39) t(i)) WHERE w >= 8 AND c >= 1)""")
def best_index(spark, sf):
    return pricing.best_index(_gaps(spark, sf), 16_000_000).select("source", "gap", F.round("best_index", 9).alias("best_index"))


#: What a profile would have measured: timings are inputs of the router, and a name without a bound has a gap of 0.
_PROFILES = [("rank_1", 0.01, 0.03, "sparse_direct", False), ("rank_2_edges", 0.01, 0.03, "pandas_groupby", False), ("rank_5", 0.03, 0.01, "pandas_groupby", True), ("rank_20_edges", 0.01, 0.0101, "sparse_direct", True), ("unheard_of", 0.01, 0.03, "sparse_direct", False)]
_PROFILES_SQL = "(VALUES " + ", ".join(f"('{s}', {a}, {b}, '{h}', {str(n).lower()})" for s, a, b, h, n in _PROFILES) + ") v(source, sparse_seconds, pandas_seconds, heuristic, native)"
_BOUNDS = """bd AS (SELECT replace(source, '_edges', '') AS source, gap AS bound FROM g),
lk AS (SELECT v.*, greatest(coalesce((SELECT min(bound) FROM bd WHERE bd.source = v.source), (SELECT min(bound) FROM bd WHERE bd.source = replace(v.source, '_edges', '')), 0.0), 0.0) AS gap FROM """ + _PROFILES_SQL + ")"


def _bounds(spark, sf):
    profiles = spark.createDataFrame(_PROFILES, "source string, sparse_seconds double, pandas_seconds double, heuristic string, native boolean")
    return pricing.with_bounds(profiles, _gaps(spark, sf).select(F.replace("source", F.lit("_edges"), F.lit("")).alias("source"), F.col("gap").alias("bound")))


@query(f"{_GAPS}, {_BOUNDS} SELECT source, gap FROM lk")
def bound_lookup(spark, sf):
    """Bounds by name, else by the name without its suffix, else 0."""
    return _bounds(spark, sf).select("source", "gap")


@query(f"""{_GAPS}, {_BOUNDS}, {_PRICE.replace("FROM g ", "FROM lk g ")},
j AS (SELECT *, CASE WHEN pandas_seconds / sparse_seconds > 1.2 THEN 'sparse_direct' WHEN pandas_seconds / sparse_seconds < 1 / 1.2 THEN 'pandas_groupby' ELSE 'indecisive' END AS profile_choice FROM pr JOIN (SELECT * EXCLUDE gap FROM lk) USING (source)),
x AS (SELECT *, CASE WHEN profile_choice = heuristic THEN profile_choice ELSE 'sparse_direct' END AS exact_choice FROM j)
SELECT source, profile_choice, exact_choice, CASE WHEN profile_choice = heuristic THEN 'agreement' WHEN profile_choice = 'indecisive' THEN 'profile undecided' ELSE 'disagreement' END AS exact_source,
CASE WHEN NOT feasible THEN 'unidentifiable' WHEN total_bytes > 1000000000 THEN 'not_worth_it' WHEN total_bytes <= 15000000 THEN 'certifiable_within_budget' ELSE 'certifiable_over_budget' END AS sketch_decision, total_bytes, feasible AND total_bytes <= 15000000 AS within_budget,
(CASE WHEN exact_choice = 'pandas_groupby' THEN 'pandas_then_' ELSE '' END) || (CASE WHEN native THEN 'graphblas_hypersparse' ELSE 'scipy_csr' END) AS backend FROM x""")
def route(spark, sf):
    out = pricing.route(_bounds(spark, sf), memory_budget=15_000_000)
    return out.select("source", "profile_choice", "exact_choice", "exact_source", "sketch_decision", "total_bytes", "within_budget", "backend")


# Sketches

_CMW, _CMD = 2048, 4


def _bucket_sql(src: str, dst: str, row: int, width: int, seed: int) -> str:
    a, b, c = sketches.hash_parameters(row, seed)
    p = sketches.PRIME
    return f"((CAST({c} AS BIGINT) * ({dst} % {p}) + (CAST({a} AS BIGINT) * ({src} % {p}) + {b}) % {p}) % {p}) % {_CMW if width is None else width}"


def _cm_rows(rows: str, extra: str) -> str:
    return " UNION ALL ".join(f"SELECT {extra}, {r} AS row, {_bucket_sql('src', 'dst', r, _CMW, sketches.SEED)} AS col FROM {rows}" for r in range(_CMD))


_CM = f"cm AS (SELECT row, col, CAST(sum(weight) AS BIGINT) AS w FROM ({_cm_rows('p', 'weight')}) GROUP BY row, col)"
_EST = f"est AS (SELECT src, dst, min(w) AS estimated_weight FROM ({_cm_rows('p', 'src, dst')}) k JOIN cm USING (row, col) GROUP BY src, dst)"


@query(f"{PAIRS_A}, {_CM} SELECT CAST(row AS INTEGER) AS row, CAST(col AS BIGINT) AS col, w FROM cm")
def count_min_table(spark, sf):
    return sketches.count_min(fx.diffuse(spark, sf), _CMW, _CMD)


@query(f"{PAIRS_A}, {_CM}, {_EST} SELECT src, dst, estimated_weight FROM est")
def count_min_estimates(spark, sf):
    e = fx.diffuse(spark, sf)
    return sketches.estimate(e.select("src", "dst").distinct(), sketches.count_min(e, _CMW, _CMD), _CMW, _CMD)


@query(f"""{PAIRS_A}, {_CM}, {_EST}, ex AS (SELECT src, dst, weight, row_number() OVER (ORDER BY weight DESC, src, dst) AS rank FROM p), ap AS (SELECT *, row_number() OVER (ORDER BY estimated_weight DESC, src, dst) AS r FROM est), c AS (SELECT * FROM ap WHERE r <= 512),
j AS (SELECT ex.*, c.r, c.estimated_weight AS e FROM (SELECT * FROM ex WHERE rank <= {K}) ex LEFT JOIN c USING (src, dst))
SELECT {R("avg(CASE WHEN r IS NULL THEN 0.0 ELSE 1.0 END)")} AS candidate_recall, {R(f"avg(CASE WHEN coalesce(r, 1000000) <= {K} THEN 1.0 ELSE 0.0 END)")} AS topk_recall, {R("median(abs(coalesce(e, 0) - weight) / CAST(weight AS DOUBLE))")} AS median_relative_error, {R("max(abs(coalesce(e, 0) - weight) / CAST(weight AS DOUBLE))")} AS max_relative_error FROM j""")
def streaming_accuracy(spark, sf):
    exact = top_k_edges(spark, sf)
    ranked = P.top_k_edges(count_min_estimates(spark, sf).withColumnRenamed("estimated_weight", "weight"), 512).withColumnRenamed("weight", "estimated_weight")
    return rounded(sketches.streaming_accuracy(exact, ranked, K))


@query(f"{with_ctes('c', pairs='c')} SELECT src, dst, CAST(weight AS DOUBLE) AS count, CAST(0 AS DOUBLE) AS error FROM p")
def space_saving_candidates(spark, sf):
    """A tracker with room for every pair counts exactly."""
    return sketches.space_saving(fx.dense(spark, sf), 1024)


@query(f"{with_ctes('skew', pairs='skew')} SELECT src, dst, weight FROM p WHERE weight > (SELECT sum(weight) FROM p) / 256.0")
def heavy_hitters(spark, sf):
    """Pairs above a share 1 / c of the weight, in two passes: a tracker of c counters surely holds them, their exact weights decide."""
    e = fx.skewed(spark, sf)
    return sketches.heavy_hitters(e, 256)


@query(f"{PAIRS_A} SELECT 512 AS candidates, true AS upper_bounds, true AS error_bounded, true AS heavy_kept")
def space_saving_guarantees(spark, sf):
    """The tracker's promises, held against exact weights: counts bound from above, errors stay below W / c, weights above W / c are kept."""
    e = fx.tied(spark, sf)
    found = sketches.space_saving(e, 512)
    pairs = P.aggregate_pairs(e)
    total = pairs.agg(F.sum("weight").alias("w"))
    both = pairs.join(found, ["src", "dst"], "left").join(F.broadcast(total))
    limit = F.col("w") / 512.0
    return both.agg(F.count("count").cast("int").alias("candidates"), F.coalesce(F.bool_and(F.col("count") >= F.col("weight")), F.lit(True)).alias("upper_bounds"), F.coalesce(F.bool_and((F.col("error") <= limit) & (F.col("count") - F.col("error") <= F.col("weight"))), F.lit(True)).alias("error_bounded"), F.bool_and((F.col("weight") <= limit) | F.col("count").isNotNull()).alias("heavy_kept"))


_BITS, _DW, _DD, _TOP, _BEAM = (14, 17), 1024, 3, 12, 512


def _dyadic_bucket_sql(p: str, level: int, row: int) -> str:
    return _bucket_sql(f"({p} >> 31)", f"({p} & {sketches.PRIME})", row, _DW, 101 + 1009 * level)


def _dyadic_sql() -> str:
    bits = sum(_BITS)
    keys = f"{PAIRS_A}, ky AS (SELECT (CAST(src AS BIGINT) << {_BITS[1]}) | CAST(dst AS BIGINT) AS key, weight FROM p)"
    cells = " UNION ALL ".join(f"SELECT {v} AS level, {r} AS row, {_dyadic_bucket_sql(f'(key >> {bits - v})', v, r)} AS col, weight FROM ky" for v in range(_TOP, bits + 1) for r in range(_DD))
    return f"{keys}, dy AS MATERIALIZED (SELECT level, row, col, CAST(sum(weight) AS BIGINT) AS w FROM ({cells}) GROUP BY 1, 2, 3)"


def _descent_sql() -> str:
    bits = sum(_BITS)
    out = [_dyadic_sql()]
    for v in range(_TOP, bits + 1):
        nodes = f"(SELECT i AS p FROM generate_series(0, {(1 << _TOP) - 1}) t(i))" if v == _TOP else f"(SELECT unnest([2 * p, 2 * p + 1]) AS p FROM n{v - 1})"
        rows = " UNION ALL ".join(f"SELECT p, {r} AS row, {_dyadic_bucket_sql('p', v, r)} AS col FROM {nodes}" for r in range(_DD))
        out.append(f"n{v} AS MATERIALIZED (SELECT p, min(coalesce(w, 0)) AS e FROM ({rows}) k LEFT JOIN (SELECT * FROM dy WHERE level = {v}) USING (row, col) GROUP BY p ORDER BY e DESC, p LIMIT {K if v == bits else _BEAM})")
    return ", ".join(out) + f" SELECT row_number() OVER (ORDER BY e DESC, p) AS rank, p >> {_BITS[1]} AS src, p & {(1 << _BITS[1]) - 1} AS dst, e AS estimated_weight FROM n{bits}"


@query(f"{_dyadic_sql()} SELECT CAST(level AS INTEGER) AS level, CAST(row AS INTEGER) AS row, CAST(col AS BIGINT) AS col, w FROM dy")
def dyadic_table(spark, sf):
    keys, bits, _ = sketches.edge_keys(fx.diffuse(spark, sf), _BITS)
    return sketches.dyadic_count_min(keys, bits, _DW, _DD, _TOP)


@query(_descent_sql())
def dyadic_top_k(spark, sf):
    keys, bits, dst_bits = sketches.edge_keys(fx.diffuse(spark, sf), _BITS)
    sketch = sketches.dyadic_count_min(keys, bits, _DW, _DD, _TOP)
    return sketches.unpack(sketches.dyadic_heavy_hitters(sketch, bits, K, _BEAM, _DW, _DD, _TOP), dst_bits)


def _identifiability_sql(name: str) -> str:
    gamma = "2 * (exp(1.0) / 8192 + 1.0 / 513)"
    return f"""{with_ctes(name, pairs=name)}, ex AS (SELECT *, row_number() OVER (ORDER BY weight DESC, src, dst) AS r FROM p), ap AS (SELECT *, row_number() OVER (ORDER BY weight DESC, dst, src) AS o FROM p), f AS (SELECT src, dst, o FROM ap WHERE o <= {K}),
l AS (SELECT CAST(sum(weight) AS DOUBLE) AS tw, max(CASE WHEN r = {K} THEN weight END) AS kth, max(CASE WHEN r = {K + 1} THEN weight END) AS nxt FROM ex),
t AS (SELECT ex.*, f.o, (weight - coalesce(nxt, 0)) / tw > {gamma} AS core FROM ex LEFT JOIN f USING (src, dst), l WHERE r <= {K})
SELECT {R(f"count(o) / {K}.0")} AS strict_recall, {R(f"least((SELECT count(*) FROM p JOIN f USING (src, dst), l WHERE o <= {K} AND weight >= kth) / {K}.0, 1.0)")} AS tie_aware_recall, count(*) FILTER (core) AS identifiable_core_size,
{R("CASE WHEN count(*) FILTER (core) > 0 THEN count(o) FILTER (core) / CAST(count(*) FILTER (core) AS DOUBLE) END")} AS identifiable_recall, count(*) FILTER (core) > 0 AS identifiable FROM t"""


def _other_order(edges: DataFrame) -> DataFrame:
    """A top k that breaks ties the other way."""
    best = P.aggregate_pairs(edges).orderBy(F.desc("weight"), "dst", "src").limit(K)
    return best.select(F.row_number().over(Window.orderBy(F.desc("weight"), "dst", "src")).alias("rank"), "src", "dst")


@query(_identifiability_sql("b"))
def identifiability_tied(spark, sf):
    e = fx.tied(spark, sf)
    return rounded(sketches.identifiability_report(e, _other_order(e), K))


@query(_identifiability_sql("c"))
def identifiability_dense(spark, sf):
    e = fx.dense(spark, sf)
    return rounded(sketches.identifiability_report(e, _other_order(e), K))


# Benchmark rows, generators, streams

_METHODS = ("sparse_direct", "pandas_groupby", "counter")
_RUNS = "(SELECT event_type AS regime, CASE user_id % 3 WHEN 0 THEN 'sparse_direct' WHEN 1 THEN 'pandas_groupby' ELSE 'counter' END AS method, event_id % 2 AS n_edges, CAST(round(value * 100) AS BIGINT) / 100.0 AS seconds FROM events) v"


def _runs(spark, sf):
    """Events read as timed runs: the type is the regime, the user the method, the value the seconds."""
    user = F.col("user_id") % 3
    method = F.when(user == 0, _METHODS[0]).when(user == 1, _METHODS[1]).otherwise(_METHODS[2])
    return fx.table(spark, sf, "events").select(F.col("event_type").alias("regime"), method.alias("method"), (F.col("event_id") % 2).alias("n_edges"), (fx.cents("value") / 100.0).alias("seconds"))


@query(f"SELECT regime, method, n_edges, {R('avg(seconds)')} AS mean, {R('coalesce(stddev_samp(seconds), 0)')} AS std FROM {_RUNS} GROUP BY 1, 2, 3")
def benchmark_means(spark, sf):
    return rounded(summary.mean_and_std(_runs(spark, sf), ["regime", "method", "n_edges"], "seconds"))


@query(f"SELECT regime, arg_min(method, (seconds, method)) AS method, min(seconds) AS seconds FROM {_RUNS} WHERE method IN ('sparse_direct', 'pandas_groupby') GROUP BY 1")
def fastest_methods(spark, sf):
    return summary.fastest(_runs(spark, sf).where(F.col("method").isin(*_METHODS[:2])), ["regime"])


@query(f"{with_ctes('d', pairs='d')} SELECT dst, {R('gini')} AS gini FROM {gini_sql('p', by='dst')}")
def gini_by_destination(spark, sf):
    return rounded(gini(P.aggregate_pairs(fx.events(spark, sf)), "weight", ["dst"]))


_SYN = (5000, 2048, 1500, 7, 24)


def _streams_sql(name: str, first: int, last: int, seed: int) -> list[str]:
    """u<name>: rows `first` to `last` with the generator's eleven streams of numbers, three quadratic rounds each."""
    g, prime = synthetic, synthetic.PRIME
    out = [f"x0{name} AS (SELECT i AS seq, {', '.join(f'i % {prime} AS x{k}' for k in range(11))} FROM generate_series({first}, {last}) t(i))"]
    for r in range(g.ROUNDS):
        cols = ", ".join(f"(x{k} * x{k} % {prime} + x{k} * CAST({g.stream(seed, k)[r][0]} AS BIGINT) + CAST({g.stream(seed, k)[r][1]} AS BIGINT)) % {prime} AS x{k}" for k in range(11))
        out.append(f"x{r + 1}{name} AS (SELECT seq, {cols} FROM x{r}{name})")
    return [*out, f"u{name} AS (SELECT seq, {', '.join(f'x{k} / CAST({prime} AS DOUBLE) AS u{k}' for k in range(11))} FROM x{g.ROUNDS}{name})"]


_SIZE_SQL = "greatest(CAST(floor(exp(5.0 + 1.1 * sqrt(-2 * ln(1 - u8)) * cos(2 * 3.141592653589793 * u9))) AS BIGINT), 1)"


def _synthetic_ctes(regime: str) -> str:
    """e<regime> with the generator's rows."""
    n, sources, targets, seed, bins = _SYN
    g = synthetic
    out = _streams_sql(regime, 0, n - 1, seed)
    pick = lambda u, m: f"CAST(floor({u} * {m}) AS BIGINT)"
    src, dst = pick("u0", sources), pick("u1", targets)
    if regime == "hotspot":
        def ranked(u: str, m: int, s: int) -> str:
            e = 1.0 - g.ZIPF
            rank = f"least(CAST(floor(pow({u} * {float(m + 1) ** e - 1.0!r} + 1.0, {1.0 / e!r})) AS BIGINT) - 1, {m - 1})"
            return f"({rank} * {g.scatter_step(m)} + {s % m}) % {m}"

        src, dst = ranked("u0", sources, seed), ranked("u1", targets, seed + 1)
    elif regime == "community":
        blocks = max(1, min(16, sources, targets))
        inside = lambda u, m: f"{pick('u2', blocks)} * {m // blocks} + {pick(u, max(1, m // blocks))}"
        src = f"CASE WHEN u4 < {g.BURST} THEN 0 WHEN u3 < {g.LOCAL} THEN {inside('u0', sources)} ELSE {src} END"
        dst = f"CASE WHEN u4 < {g.BURST} THEN {pick('u5', max(1, targets // 64))} WHEN u3 < {g.LOCAL} THEN {inside('u1', targets)} ELSE {dst} END"
    elif regime == "scanner":
        src = f"CASE WHEN u3 < {g.SCAN} THEN {pick('u4', 3)} % {sources} ELSE {src} END"
    return ", ".join([*out, f"e{regime} AS (SELECT seq, {src} AS src, {dst} AS dst, {_SIZE_SQL} AS weight, CAST(floor(u10 * {bins}) AS INTEGER) AS time_bin FROM u{regime})"])


def _synthetic(spark, regime: str) -> DataFrame:
    n, sources, targets, seed, bins = _SYN
    return E.normalise(synthetic.make_edges(spark, n, sources, targets, regime, seed, bins))


def _every(names, row: str) -> str:
    return " UNION ALL ".join(row.format(x=x) for x in names)


@query(f"WITH {', '.join(map(_synthetic_ctes, synthetic.REGIMES))} {_every(synthetic.REGIMES, "SELECT '{x}' AS regime, seq, time_bin, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, CAST(weight AS BIGINT) AS weight FROM e{x}")}")
def synthetic_edges(spark, sf):
    """The generator's rows, every regime."""
    return reduce(DataFrame.unionByName, (_synthetic(spark, r).select(F.lit(r).alias("regime"), "seq", "time_bin", "src", "dst", "weight") for r in synthetic.REGIMES))


@query(f"""WITH {', '.join(map(_synthetic_ctes, synthetic.REGIMES))}, {', '.join(_features_sql(r, r) for r in synthetic.REGIMES)}, u AS ({_every(synthetic.REGIMES, 'SELECT * FROM f{x}')}), g AS (SELECT *, {_shape_sql("u")} AS shape FROM u)
SELECT source, observed_edges, unique_pairs, unique_sources, unique_destinations, {", ".join(f"{R(c)} AS {c}" for c in _FEATURES)}, shape, {_METHOD_SQL} FROM g""")
def synthetic_features(spark, sf):
    """Features and advice for every regime of the generator."""
    rows = [decisions.recommend(decisions.early_features(_synthetic(spark, r), _HEAD)).select(F.lit(r).alias("source"), "*") for r in synthetic.REGIMES]
    return rounded(reduce(DataFrame.unionByName, rows))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS records, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS weight FROM events GROUP BY 1, 2")
def streaming_daily_totals(spark, sf):
    """The event table as a stream of its file, by day and type, run over all that is there."""
    from ..streaming import jobs

    schema = fx.table(spark, sf, "events").schema
    stream = jobs.edge_stream(spark, f"{sf}/events.parquet*", schema).withColumn("weight", fx.cents("value"))
    out = jobs.collect_stream(jobs.windowed_totals(stream, keys=("event_type",)), f"daily_{uuid.uuid4().hex}")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# Files: written to the shared folder and read back


def _scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/flowsieve/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


_PACKETS = "SELECT event_id AS seq, user_id AS src, event_id % 97 AS dst, CAST(round(value * 100) AS BIGINT) + 60 AS weight FROM events"


def _capture(spark, sf, payload) -> DataFrame:
    rows = fx.events(spark, sf).select("seq", "src", (F.col("seq") % 97).alias("dst"), (F.col("weight") + 60).alias("weight"), payload.alias("payload"))
    path = _scratch(spark, "c.pcap")
    os.makedirs(os.path.dirname(path.removeprefix("file://").removeprefix("file:")), exist_ok=True)
    sinks.write_pcap(path, rows)
    return pcap.read_pcap(spark, path, split=1 << 16)


@query(_PACKETS)
def pcap_scan(spark, sf):
    """Events as packets of one size: read in ranges."""
    return _capture(spark, sf, F.lit(0))


@query(_PACKETS)
def pcap_scan_drift(spark, sf):
    """The same with packets whose size changes from the 701st on: ranges, then one task."""
    return _capture(spark, sf, F.when(F.col("seq") >= 700, F.col("seq") % 5).otherwise(0))


@query(f"{with_ctes('d', pairs='d')} SELECT CAST(src AS VARCHAR) AS src, dst, CAST(weight AS DOUBLE) AS weight FROM p")
def csv_scan(spark, sf):
    path = _scratch(spark, "edges_csv")
    fx.events(spark, sf).select("src", "dst", F.col("weight").alias("bytes")).write.option("header", True).csv(path)
    return P.aggregate_pairs(E.read_edges(spark, path))


@query(f"{with_ctes('d', pairs='d')} SELECT src, dst, weight FROM p")
def parquet_scan(spark, sf):
    path = _scratch(spark, "edges.parquet")
    fx.events(spark, sf).select("src", "dst", F.col("weight").alias("packets")).write.parquet(path)
    return P.aggregate_pairs(E.read_edges(spark, path))


@query(f"""{with_ctes("d", pairs="d")}, s AS (SELECT src, row_number() OVER (ORDER BY src) - 1 AS row FROM (SELECT DISTINCT src FROM p)),
t AS (SELECT dst, row_number() OVER (ORDER BY dst) - 1 AS col FROM (SELECT DISTINCT dst FROM p)) SELECT row AS src, col AS dst, CAST(weight AS DOUBLE) AS weight FROM p JOIN s USING (src) JOIN t USING (dst)""")
def matrix_market_scan(spark, sf):
    path = _scratch(spark, "m")
    sinks.write_matrix_market(path, P.aggregate_pairs(fx.events(spark, sf)))
    return E.read_matrix_market(spark, path)[0]


@query(f"""{with_ctes("d", pairs="d")} SELECT c.check, n_source, n_destination, nnz, {R("nnz / CAST(n_source * n_destination AS DOUBLE)")} AS density, total_weight, true AS matches
FROM (SELECT count(DISTINCT src) AS n_source, count(DISTINCT dst) AS n_destination, count(*) AS nnz, CAST(sum(weight) AS DOUBLE) AS total_weight FROM p), (VALUES ('edge_table'), ('matrix_market')) c("check")""")
def format_smoke(spark, sf):
    return rounded(sweeps.format_smoke(P.aggregate_pairs(fx.events(spark, sf)), _scratch(spark, "m")))


@query(f"""{with_ctes("d", pairs="d")}, h AS (SELECT count(DISTINCT src) AS n_source, count(DISTINCT dst) AS n_destination, count(*) AS nnz, CAST(sum(weight) AS DOUBLE) AS total_weight FROM p)
SELECT 'summary' AS implementation, *, {R("nnz / CAST(n_source * n_destination AS DOUBLE)")} AS density, CAST(0 AS BIGINT) AS src_similarity_nnz, CAST(0 AS BIGINT) AS dst_similarity_nnz FROM h UNION ALL
SELECT 'formulas', *, {R("nnz / CAST(n_source * n_destination AS DOUBLE)")}, (SELECT count(*) FROM (SELECT DISTINCT x.src, y.src AS o FROM p x JOIN p y ON x.dst = y.dst)), (SELECT count(*) FROM (SELECT DISTINCT x.dst, y.dst AS o FROM p x JOIN p y ON x.src = y.src)) FROM h""")
def formula_comparison(spark, sf):
    return rounded(sweeps.formula_comparison(P.aggregate_pairs(fx.events(spark, sf))).drop("seconds"))


@query(f"""{PAIRS_A} SELECT 'top_edges' AS part, row_number() OVER (ORDER BY weight DESC, src, dst) AS label, weight FROM p QUALIFY label <= {K}
UNION ALL SELECT 'src_strength', src, CAST(sum(weight) AS BIGINT) FROM p GROUP BY src UNION ALL SELECT 'dst_strength', dst, CAST(sum(weight) AS BIGINT) FROM p GROUP BY dst UNION ALL SELECT 'summary', count(*), CAST(sum(weight) AS BIGINT) FROM p""")
def saved_analysis(spark, sf):
    """What the analysis folders hold."""
    paths = sinks.save_analysis(_scratch(spark, "a"), P.aggregate_pairs(fx.diffuse(spark, sf)), K, "parquet")
    columns = {"summary": ("nnz", "total_weight"), "top_edges": ("rank", "weight")}
    frames = []
    for path in paths:
        part = next(n for n in ("summary", "top_edges", "src_strength", "dst_strength") if path.endswith(f"_{n}"))
        label, weight = columns.get(part, ("label", "strength"))
        frames.append(spark.read.parquet(path).select(F.lit(part).alias("part"), F.col(label).cast("long").alias("label"), F.col(weight).cast("long").alias("weight")))
    return reduce(DataFrame.unionByName, frames)


@query(f"{with_ctes('a')} SELECT 'lineitem' AS source, count(*) AS records, count(DISTINCT src) AS unique_sources, count(DISTINCT dst) AS unique_destinations, count(DISTINCT (src, dst)) AS unique_pairs, min(weight) AS min_weight, max(weight) AS max_weight, CAST(sum(weight) AS BIGINT) AS total_weight, '{hashlib.sha256(b'edges').hexdigest()}' AS sha256 FROM ea")
def manifest_fields(spark, sf):
    """The provenance manifest, written as JSON and read back."""
    text = sinks.manifest(fx.diffuse(spark, sf), "lineitem", b"edges")
    path = _scratch(spark, "manifest")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    names = ("records", "unique_sources", "unique_destinations", "unique_pairs", "min_weight", "max_weight", "total_weight")
    return spark.read.option("multiLine", True).json(path).select("source", *names, "sha256")


# Drivers


def _named(spark, sf) -> dict[str, DataFrame]:
    return {"diffuse": fx.diffuse_sequenced(spark, sf), "dense_edges": fx.dense(spark, sf)}


@query()
def identifiable_recall(spark, sf):
    return rounded(sweeps.identifiable_recall(_named(spark, sf)))


@query()
def priced_recall(spark, sf):
    prices = pricing.price(spark.createDataFrame([("diffuse", 0.01), ("dense_edges", 0.02), ("none", 0.0)], "source string, gap double"))
    return rounded(sweeps.priced_recall(_named(spark, sf), prices))


@query()
def anomaly_ranking(spark, sf):
    return rounded(sweeps.anomaly_ranking(spark, n=20_000, labels=512)[1], 4)


def _controlled_sql(name: str, n: int, sources: int, targets: int, nnz: int, seed: int, bins: int, scanners: float, bursts: float) -> str:
    cells = sources * targets
    slot = f"CASE WHEN seq < {min(n, nnz)} THEN seq ELSE CAST(floor(u0 * {nnz}) AS BIGINT) END"
    cell = f"(({slot}) * {synthetic.scatter_step(cells)} + {seed % cells}) % {cells}"
    return f"""{", ".join(_streams_sql(name, 0, n - 1, seed))}, e{name} AS (SELECT seq, CAST(CASE WHEN u4 < {bursts} THEN {bins // 2} ELSE floor(u10 * {bins}) END AS INTEGER) AS time_bin,
CASE WHEN u3 < {scanners} THEN 0 ELSE ({cell}) // {targets} END AS src, ({cell}) % {targets} AS dst, {_SIZE_SQL} AS bytes FROM u{name})"""


@query(f"WITH {_controlled_sql('ctl', 4000, 64, 48, 700, 7, 8, 0.1, 0.1)} SELECT seq, time_bin, printf('s%08d', src) AS src, printf('d%08d', dst) AS dst, bytes FROM ectl")
def controlled_edges(spark, sf):
    """Records over a fixed number of pairs, with scanners and bursts, under text labels."""
    rows = synthetic.make_controlled_edges(spark, 4000, 64, 48, target_nnz=700, scanners=0.1, bursts=0.1, bins=8)
    return rows.select("seq", "time_bin", synthetic.label(F.col("src"), "s", True).alias("src"), synthetic.label(F.col("dst"), "d", True).alias("dst"), "bytes")


_ANOM = (3000, 128, 12, 5, 59)


def _anomaly_rows_sql(scenario: str) -> str:
    n, labels, bins, bad, seed = _ANOM
    any_ = lambda i: f"CAST(floor(u{i} * {labels}) AS BIGINT)"
    src, dst, size = {"volume_spike": (any_(0), any_(1), 20_000), "scan": ("1", f"seq % {labels}", 60), "hotspot": ("2", "3", 5_000), "fan_in": (f"seq % {labels}", "5", 400)}[scenario]
    return f"SELECT '{scenario}' AS scenario, * FROM ebase UNION ALL SELECT '{scenario}', seq, {bad}, {src}, {dst}, {size} FROM uextra"


@query(f"WITH {_controlled_sql('base', _ANOM[0], _ANOM[1], _ANOM[1], round(_ANOM[0] * 0.7), _ANOM[4], _ANOM[2], 0.0, 0.0)}, {', '.join(_streams_sql('extra', _ANOM[0], _ANOM[0] * 11 // 10 - 1, _ANOM[4] + 1))} {' UNION ALL '.join(map(_anomaly_rows_sql, synthetic.SCENARIOS))}")
def anomaly_edges(spark, sf):
    """Every scenario's edges: base traffic and what is injected in one bin."""
    n, labels, bins, bad, seed = _ANOM
    return reduce(DataFrame.unionByName, (synthetic.make_anomaly_edges(spark, x, n, labels, bins, bad, seed).withColumn("scenario", F.lit(x)) for x in synthetic.SCENARIOS))


@query(f"WITH {_synthetic_ctes('community')} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, CAST(sum(weight) AS BIGINT) AS weight FROM ecommunity GROUP BY 1, 2")
def synthetic_scan(spark, sf):
    """Generated edges written as files, scanned and aggregated."""
    path = _scratch(spark, "edges.parquet")
    n, sources, targets, seed, bins = _SYN
    synthetic.write_edges(synthetic.make_edges(spark, n, sources, targets, "community_bursty", seed, bins), path)
    return P.aggregate_pairs(E.read_edges(spark, path))


# The sketch path as a whole


def _cm_of(pairs: str, width: int, depth: int, name: str) -> str:
    rows = lambda table, extra: " UNION ALL ".join(f"SELECT {extra}, {r} AS row, {_bucket_sql('src', 'dst', r, width, sketches.SEED)} AS col FROM {table}" for r in range(depth))
    return f"cm{name} AS (SELECT row, col, CAST(sum(weight) AS BIGINT) AS w FROM ({rows(pairs, 'weight')}) GROUP BY row, col), est{name} AS (SELECT src, dst, min(w) AS e FROM ({rows(pairs, 'src, dst')}) k JOIN cm{name} USING (row, col) GROUP BY src, dst)"


_SW, _SD = 256, 3


@query(f"""{with_ctes("c", pairs="c")} SELECT (SELECT count(*) FROM ec) AS n_edges, CAST(sum(weight) AS DOUBLE) AS total_weight, count(DISTINCT src) AS unique_sources, (SELECT {R(entropy("w"))} FROM (SELECT sum(weight) AS w FROM p GROUP BY src)) AS row_entropy_bits,
count(DISTINCT dst) AS unique_destinations, (SELECT {R(entropy("w"))} FROM (SELECT sum(weight) AS w FROM p GROUP BY dst)) AS column_entropy_bits, CAST({_SW * _SD * 8} AS BIGINT) AS sketch_bytes, count(*) AS candidate_count FROM p""")
def stream_totals(spark, sf):
    e = fx.dense(spark, sf)
    return rounded(sketches.stream_summary(e, sketches.space_saving(e, 1024), sketches.count_min(e, _SW, _SD), _SW, _SD)[0])


@query(f"{with_ctes('c', pairs='c')}, {_cm_of('p', _SW, _SD, 's')} SELECT row_number() OVER (ORDER BY e DESC, src, dst) AS rank, src, dst, e AS estimated_weight FROM ests")
def stream_ranking(spark, sf):
    e = fx.dense(spark, sf)
    return sketches.stream_summary(e, sketches.space_saving(e, 1024), sketches.count_min(e, _SW, _SD), _SW, _SD)[1]


@query(f"""{_descent_sql().rsplit(" SELECT row_number()", 1)[0]}, ap AS (SELECT p >> {_BITS[1]} AS src, p & {(1 << _BITS[1]) - 1} AS dst, e, row_number() OVER (ORDER BY e DESC, p) AS r FROM n{sum(_BITS)}), ex AS (SELECT src, dst, weight, row_number() OVER (ORDER BY weight DESC, src, dst) AS rank FROM p QUALIFY rank <= {K}),
j AS (SELECT ex.*, ap.r, ap.e FROM ex LEFT JOIN ap USING (src, dst)) SELECT {R("avg(CASE WHEN r IS NULL THEN 0.0 ELSE 1.0 END)")} AS candidate_recall, {R(f"avg(CASE WHEN coalesce(r, 1000000) <= {K} THEN 1.0 ELSE 0.0 END)")} AS topk_recall,
{R("median(abs(coalesce(e, 0) - weight) / CAST(weight AS DOUBLE))")} AS median_relative_error, {R("max(abs(coalesce(e, 0) - weight) / CAST(weight AS DOUBLE))")} AS max_relative_error FROM j""")
def dyadic_recall(spark, sf):
    """Accuracy of the decoder's top k."""
    return rounded(sketches.streaming_accuracy(top_k_edges(spark, sf), dyadic_top_k(spark, sf), K))


_PW = (64, 512)


@query(f"""{with_ctes("c", pairs="c")}, {", ".join(_cm_of("p", w, 5, str(w)) for w in _PW)}, gp AS (SELECT *, row_number() OVER (ORDER BY weight DESC, src, dst) AS rank, lead(weight) OVER (ORDER BY weight DESC, src, dst) AS nxt FROM p),
gg AS (SELECT (weight - nxt) / (SELECT CAST(sum(weight) AS DOUBLE) FROM p) AS gap FROM gp WHERE rank = {K}) {" UNION ALL ".join(f"SELECT {w} AS width, 1024 AS capacity, 1.0::DOUBLE AS candidate_recall, (SELECT {R('avg(CASE WHEN r <= 20 THEN 1.0 ELSE 0.0 END)')} FROM gp JOIN (SELECT src, dst, row_number() OVER (ORDER BY e DESC, src, dst) AS r FROM est{w}) USING (src, dst) WHERE rank <= {K}) AS topk_recall, {R('gap', 9)} AS gap, {R(f'gap / (2 * (exp(1.0) / {w} + 1.0 / 1025))', 9)} AS index FROM gg" for w in _PW)}""")
def phase_points(spark, sf):
    """Gap, budget and measured recall, with room for every candidate."""
    return rounded(sweeps.phase_points(fx.dense(spark, sf), _PW, (1024,), K), 9)
