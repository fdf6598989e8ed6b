"""Every catalog query against its SQL counterpart."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_points
from quire.plans.catalog import QUERIES

duckdb = pytest.importorskip("duckdb")
SF_DIR = os.environ.get("QUIRE_TEST_SF_DIR", "/root/testdata/sf0.001")
#: No column expression finds a longest common subsequence.
PYTHON = {"line_hunks", "moved_line_hunks"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in sorted(os.listdir(SF_DIR)):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{file}'")
    return connection


def test_every_query_has_a_counterpart():
    assert set(QUERIES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    result = entry_points.queries()[name](spark, SF_DIR)
    plan = result._jdf.queryExecution().executedPlan().toString()
    for shape in ("CartesianProduct", "NestedLoopJoin", "SinglePartition"):
        assert shape not in plan
    assert name in PYTHON or "EvalPython" not in plan
    columns = sorted(result.columns)
    got = [tuple(row[c] for c in columns) for row in result.collect()]
    oracle = tables.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in oracle.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = [tuple(row[i] for i in order) for row in oracle.fetchall()]

    def key(row):
        return [(value is None, str(value)) for value in row]

    assert sorted(got, key=key) == sorted(expected, key=key)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
