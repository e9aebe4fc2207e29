"""Each query of the engine against the SQL that says the same, run by DuckDB on the same files."""

import os

import duckdb
import pytest

import __spark_entry__
from brindle.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == cols
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    assert got == sorted((tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()), key=str)


def test_entry_module(spark):
    assert set(SQL) == set(QUERIES) and set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark):
    plan = QUERIES["filter_eq_num"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,42)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan
