import pytest
from quillon.queries import ORACLE_SQL, QUERIES

from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_threshold_has_no_limit(spark, sf):
    assert "Limit" not in QUERIES["search_threshold"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
