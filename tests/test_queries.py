"""Registered queries against their SQL on the driver's smallest tables."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexgrove.plans import queries, rule_queries, service_queries, statute_queries, store_queries  # noqa: F401  they register their queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def cell(v):
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    try:
        return f"{float(v):.9g}" if not isinstance(v, (str, datetime.date)) else str(v)
    except TypeError:
        return str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in queries.NAMES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    frame = queries.QUERIES[name](spark, SF)
    found = db.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(frame.columns) == sorted(names)
    table = lambda cols, rows: sorted(tuple(cell(r[i]) for i in sorted(range(len(cols)), key=lambda i: cols[i])) for r in rows)
    assert table(frame.columns, [tuple(r) for r in frame.collect()]) == table(names, found.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_down_and_stay_native(spark):
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    plan = queries.asof_latest_version(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan and "Python" not in plan
    plan = queries.token_count(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
