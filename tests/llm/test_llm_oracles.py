import pytest

from tablewright.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, QUERIES[name], ORACLE_SQL[name]) is None
