"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert differences(entry.queries()[name](spark, FOLDER), con, SQL[name]) == []


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["species", "period", "variable", "mean", "lower", "upper"] and df.count() > 0
