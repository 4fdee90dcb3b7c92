"""Every registered query that has SQL gives the same rows as DuckDB."""

import pytest

import __spark_entry__ as entry
from symbolmill.plans import index, problems
from tests.oracle import connect, differences

BASE = "/root/testdata/sf0.001"
NAMES = [n for plan in (problems, index) for n in plan.QUERIES if n in plan.SQL]


@pytest.fixture(scope="module")
def con():
    return connect(BASE)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    mine, theirs, _ = differences(entry.queries()[name](spark, BASE), con, entry.oracle_sql()[name])
    assert not mine and not theirs


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
