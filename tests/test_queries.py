import pytest

from linelake.plans import geometry_queries, line_queries, relational_queries
from tests.compare import duck, same

QUERIES = geometry_queries.QUERIES | relational_queries.QUERIES | line_queries.QUERIES
SQL = geometry_queries.SQL | relational_queries.SQL | line_queries.SQL


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, sf, con, name):
    same(QUERIES[name](spark, sf), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0 or name == "walk_ends"  # few points at this size


def test_greedy_ways_agree(spark, sf):
    cols = ["f1", "f2", "id1", "id2", "rating"]
    a, b = (sorted(map(tuple, QUERIES[n](spark, sf).select(*cols).collect())) for n in ("match_greedy", "match_greedy_in_frames"))
    assert a == b and a


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
