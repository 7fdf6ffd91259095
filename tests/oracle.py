"""Runs a query and its SQL and compares the rows."""

import glob
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(str(v) for v in r) for r in df.itertuples(index=False, name=None))


def same(spark, sf, name, queries, sql):
    got, want = queries[name](spark, sf).toPandas(), connect(sf).sql(sql[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:
        if "datetime" in str(got[c].dtype):
            got[c], want[c] = got[c].astype("datetime64[us]"), want[c].astype("datetime64[us]")
    assert rows(got) == rows(want)
