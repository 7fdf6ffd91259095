"""Sources and pairs whose weights sum to 0 have no share in an entropy, as in the reference. The SQL of these queries takes 0 * log2(0) for them,
which DuckDB calls NaN; with that term left out, and nothing else changed, it gives the same rows."""

import os

import duckdb
import pytest

from flowsieve.plans.catalog import ORACLE_SQL, QUERIES

from .oracle import connect, rows, same


@pytest.fixture
def zeros(sf, tmp_path):
    """The tables, with events of no value for every fifth user."""
    for f in os.listdir(sf):
        if f != "events.parquet":
            os.symlink(os.path.join(sf, f), tmp_path / f)
    duckdb.connect().execute(f"copy (select * replace (case when user_id % 5 = 0 then 0.0 else value end as value) from '{sf}/events.parquet') to '{tmp_path}/events.parquet' (format parquet)")
    return str(tmp_path)


def without_zeros(sql):
    out = sql
    for c in ("s", "weight"):
        out = out.replace(f"log2(CAST({c} AS DOUBLE))", f"log2(nullif(CAST({c} AS DOUBLE), 0))")
    assert out != sql
    return out


@pytest.mark.parametrize("name", ["early_features", "timebin_summary", "timebin_anomaly"])
def test_zero_sums_have_no_entropy(spark, zeros, name):
    same(spark, zeros, name, QUERIES, {name: without_zeros(ORACLE_SQL[name])})
    plain = rows(connect(zeros).sql(ORACLE_SQL[name]).df())
    assert any("nan" in r for r in plain)
