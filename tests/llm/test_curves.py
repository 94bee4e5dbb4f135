import itertools

import numpy as np
from pyspark.sql import functions as F

from tablewright.llm.curves import hilbert_keys, nearest_neighbours, op3_nearest_neighbours


def test_hilbert_curve_visits_neighbouring_cells():
    for n, bits in ((2, 4), (3, 3)):
        grid = np.array(list(itertools.product(range(2**bits), repeat=n)))
        keys = hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(2 ** (n * bits)))
        walk = grid[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def brute(rows, asks, k=20):
    """rows: (id, vector) with unique ids."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero([asks(v) for v in ids]):
        scores = x @ x[i]
        order = [j for j in np.lexsort((ids, -scores)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def check(got, want, recall):
    lists = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        lists.setdefault(r.query_id, []).append(r)
    assert set(lists) == set(want)
    hits = 0
    for q, rs in lists.items():
        assert [r.rank for r in rs] == list(range(1, len(want[q]) + 1))
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
        hits += len({r.vec_id for r in rs} & {i for i, _ in want[q]})
    assert hits >= recall * sum(map(len, want.values()))
    return lists


def test_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(op3_nearest_neighbours(spark, sf).collect(), brute(rows, lambda i: i % 20 == 0), 0.9)


def test_narrow_windows_find_clusters(spark):
    rnd = np.random.default_rng(8)
    x = (rnd.normal(size=(60, 1, 16)) * 4 + rnd.normal(size=(60, 40, 16)) * 0.3).reshape(-1, 16)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(z) for z in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest_neighbours(df, F.col("vec_id") % 20 == 0, block=64, width=0.05).collect()
    check(got, brute(rows, lambda i: i % 20 == 0), 0.9)


def test_edge_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [1.0]), (40, None), (None, [1.0, 1.0]), (3, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string")
    got = nearest_neighbours(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 2, 1.0), (0, 3, 1.0), (0, 3, 1.0), (0, 20, 0.0), (20, 0, 0.0), (20, 2, 0.0), (20, 3, 0.0), (20, 3, 0.0)]
    assert nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest_neighbours(df.limit(1), F.col("vec_id") % 20 == 0).count() == 0
