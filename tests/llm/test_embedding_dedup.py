import math

import numpy as np

from tablewright.llm.components import Forest
from tablewright.llm.embedding_dedup import join_intervals, near_duplicate_embeddings, op2_embedding_dedup, project, unit
from tests.llm.test_simhash import brute_components


def good(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, cosine=0.98):
    """rows: (id, vector, label); ids are unique."""
    part = {i: (unit(np.array([v], float))[0], k) for i, v, k in rows if good(v) and k is not None}

    def linked(a, b):
        return a in part and b in part and part[a][1] == part[b][1] and len(part[a][0]) == len(part[b][0]) and part[a][0] @ part[b][0] >= cosine

    ids = [r[0] for r in rows]
    components = brute_components(ids, linked)
    return {i: (sum(linked(i, j) for j in ids if j != i), components[i], components[i] == i) for i in ids}


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op2_embedding_dedup(spark, sf_dir).collect()}
    assert got == brute(rows)


def test_clusters_over_many_intervals(spark):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(6, 12))
    x = [*(c + rnd.normal(size=12) * s for c in centres for s in (0.0, 0.05, 0.1, 0.2) for _ in range(15)), *rnd.normal(size=(60, 12))]
    rows = [(i, [float(np.float32(z)) for z in v * rnd.uniform(0.5, 3)], int(i % 2)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicate_embeddings(df, interval=32, dimensions=3, sample=100).collect()}
    assert got == brute(rows) and sum(v[0] for v in got.values()) > 100


def test_recursion_is_exact():
    rnd = np.random.default_rng(6)
    base = rnd.normal(size=(40, 8))
    x = unit(np.concatenate([base + 0.05 * rnd.normal(size=base.shape) for _ in range(8)]))
    labels = np.zeros(len(x), int)
    coords = project(x, labels, {0: x.mean(0)}, np.linalg.qr(rnd.normal(size=(8, 3)))[0])
    order = np.lexsort(coords.T[::-1])
    links, forest = np.zeros(len(x), np.int64), Forest(len(x))
    join_intervals(order, order, True, x, coords, np.ones(len(x), np.int64), 0.98, links, forest)
    assert (links == ((x @ x.T >= 0.98).sum(1) - 1)).all()


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1),
        (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0], 1), (12, [], 1), (13, [-1.0, 0.0], 1),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicate_embeddings(df).collect()}
    assert got == brute(rows) and got[1] == (2, 1, True) and got[3] == (2, 1, False)
    assert near_duplicate_embeddings(df.limit(0)).count() == 0
    twice = near_duplicate_embeddings(df.where("vec_id = 4").unionAll(df.where("vec_id = 4"))).collect()
    assert [(r.n_links, r.component_id) for r in twice] == [(1, 4), (1, 4)]
