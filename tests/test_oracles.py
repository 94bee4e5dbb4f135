import pytest

from tablewright import catalog
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, catalog.QUERIES[name], catalog.ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
