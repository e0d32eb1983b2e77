import oracle
import pytest

from tessera.plans import mosaic, preparation

QUERIES, SQL = mosaic.QUERIES | preparation.QUERIES, mosaic.SQL | preparation.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, data, name):
    assert oracle.differences(spark, data, QUERIES[name], SQL[name]) == ([], [])


@pytest.mark.parametrize("name", sorted(set(mosaic.QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    df = mosaic.QUERIES[name](spark, data)
    assert df.count() > 0
