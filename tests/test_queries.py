"""Every registered query with SQL gives the same rows as the SQL; the others give rows."""

import pytest
from harness import DATA, compare, connection

from lookalike.plans import registry


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, con, name):
    got, want = compare(spark, con, registry.QUERIES[name], registry.SQL[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_edges_by_cells_miss_no_pair(spark, con):
    query = registry.QUERIES["edges_by_cells"]
    got, want = compare(spark, con, query, registry.SQL["edges_accept_visual"])
    assert got == want
    assert "FlatMapGroupsInArrow" not in query(spark, DATA)._jdf.queryExecution().executedPlan().toString()
