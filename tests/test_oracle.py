"""Every registered query against DuckDB, or against its own invariants."""

from __future__ import annotations

import pytest
from compare import connect, difference

import __spark_entry__ as driver

SQL = driver.oracle_sql()
QUERIES = driver.queries()


@pytest.fixture(scope="module")
def con(tables):
    with connect(tables) as connection:
        yield connection


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert driver.entry(spark).limit(5).count() == 5


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tables, con, name):
    assert difference(QUERIES[name](spark, tables), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, tables, name):
    assert QUERIES[name](spark, tables).count() > 0
