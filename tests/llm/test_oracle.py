"""The text queries that SQL can say give the same rows as DuckDB."""

import pytest

from symbolmill.llm import queries
from tests.oracle import connect, differences

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(BASE)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, con, name):
    mine, theirs, _ = differences(queries.QUERIES[name](spark, BASE), con, queries.SQL[name])
    assert not mine and not theirs


@pytest.mark.parametrize("name", ["p4_found", "p5_found", "p6_found", "p8_report"])
def test_queries_without_sql_have_rows(spark, name):
    df = queries.QUERIES[name](spark, BASE)
    assert df.count() > 0 and df.count() == df.distinct().count()
