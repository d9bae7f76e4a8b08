"""Every registered query runs; those with SQL give exactly its rows."""

import pytest

import __spark_entry__ as entry_points
from gridpulse.schema import KEY
from tests.oracle import connect, differences

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, database, name):
    assert differences(QUERIES[name](spark, FOLDER), database, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert sum(r.n_hours for r in rows) > 0 and KEY not in rows[0]


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
