import __spark_entry__ as entry


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
