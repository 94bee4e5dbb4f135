"""Connected components of a link table, and spanning forests inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, remove_folder, table_at


class Forest:
    """Union of links among n local nodes; hands back one link a joined node instead of all pairs."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        parent = self.parent
        while len(a):
            ra, rb = parent[a], parent[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent[:] = up

    def joined(self, *nodes: np.ndarray) -> bool:
        """Whether all these nodes are in one tree already."""
        root = self.parent[nodes[0][0]]
        return all((self.parent[x] == root).all() for x in nodes)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return child, self.parent[child]


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest node reachable.

    Alternating large-star and small-star rounds, each put to rest as a table: every round
    hangs nodes under smaller neighbours by a min aggregate and a join, so a node with
    very many links is pre-aggregated and its rows can be split. A round's table goes once
    its successor is written; the last one stays, as the result reads from it. Self-links
    and nulls are ignored.
    """
    spark = links.sparkSession
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}").distinct()
    path = new_folder(spark)
    pairs, before = table_at(pairs, path), None
    for _ in range(max_rounds):
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        both = pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("u", "m").alias("m"))
        large = pairs.join(least, F.col("v") == F.col("at")).select("u", F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # one row a link: its upper end, or else its lower end, hangs under the upper end's least neighbour; one of an upper end's links has that neighbour, so none gets lost
        hung = large.join(low, "u").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        path, last = new_folder(spark), path
        pairs = table_at(hung.distinct(), path)
        remove_folder(spark, last)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
