"""Differential test: every registered query against its DuckDB oracle on sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, rows_key

ORACLE = E.oracle_sql()
NAMES = sorted(E.queries())


@pytest.fixture(scope="module")
def con(small_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{small_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, small_dir, name):
    sdf = E.queries()[name](spark, small_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    if name not in ORACLE:
        pytest.skip("no SQL oracle (checked elsewhere)")
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert sorted(scols) == sorted(dcols)
    assert rows_key(srows, scols) == rows_key(res.fetchall(), dcols)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "efficiency_score" in df.columns
