"""Runs a query and its SQL over the same tables and compares the rows."""

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def compare(spark, sf_dir, query, sql):
    """None, or what differs."""
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = query(spark, sf_dir)
    want = db.sql(sql)
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    cols = sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in cols]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    if a != b:
        only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{len(a)} and {len(b)} rows; only in Spark {only_a}; only in SQL {only_b}"
    return None if a else "no rows"
