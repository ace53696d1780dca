import pytest

from tidemark.plans import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(same, name):
    same(Q.QUERIES[name], Q.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_query_runs(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).columns
    Q.QUERIES[name](spark, sf).count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
