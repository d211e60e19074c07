"""Comparing a query's rows with DuckDB's on the same tables."""

import os

import pytest

DATA = os.environ.get("KINWEAVE_TESTDATA", "/root/testdata/sf0.001")


def _value(x):
    if x is None or (isinstance(x, float) and x != x):
        return "null"
    return f"{float(x):.8g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def compare(spark, run, sql):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    got, cur = run(spark, DATA), con.execute(sql)
    names = sorted(got.columns)
    at = {d[0]: k for k, d in enumerate(cur.description)}
    assert sorted(at) == names
    want = sorted(tuple(_value(r[at[c]]) for c in names) for r in cur.fetchall())
    assert sorted(tuple(_value(r[c]) for c in names) for r in got.collect()) == want
