"""Every named query against its check SQL, and what its plan must not hold."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from burdenflow.catalogue.queries import REGISTRY
from check import TABLES, bag

FOLDER = "/root/testdata/sf0.001"
BANNED = ["CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not found")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_check_sql():
    assert set(REGISTRY) <= set(queries()) and set(REGISTRY) <= set(oracle_sql())


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, con, name):
    df = queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in BANNED if word in plan]
    cursor = con.execute(oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    mine, theirs = bag(df.columns, df.collect()), bag(columns, cursor.fetchall())
    assert mine and mine == theirs


def test_entry(spark):
    assert entry(spark).count() > 0
