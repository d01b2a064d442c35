"""The catalogue against DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from lattica.plans import catalogue

SF = "/root/testdata/sf0.001"
FAST = [n for n in catalogue.ORACLES if n not in ("pagerank_20", "cc_sizes", "cc_count", "result_check", "pagerank_q40", "bfs_histogram")]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)
    assert got == want
