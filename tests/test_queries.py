import pytest

from memspark import flow_queries, queries
from tests.compare import assert_same

QUERIES, SQL = queries.queries() | flow_queries.queries(), queries.oracle_sql() | flow_queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
