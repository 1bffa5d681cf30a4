"""Every registered query of the engine against its SQL in DuckDB, at the smallest scale; plans that must hold at any scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from evq.queries import QUERIES, flagship

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "lineitem", "customer", "events")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name].run(spark, SF)
    columns = sorted(df.columns)
    want = duck.execute(QUERIES[name].sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = [tuple(r[names.index(c)] for c in columns) for r in want.fetchall()]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, rows))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_reads_what_it_needs(spark):
    plan = flagship(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "ReadSchema: struct<o_orderkey" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
