"""Approximate nearest neighbours over shifted space-filling curves.

Several Hilbert orderings of the vectors, each over its own rotated projection and
shifted grid. Spark range-partitions the keys of each ordering; a row's place in it
follows from partition sizes. A query looks at the candidates in a window around its
own place in every ordering; windows are dealt to blocks of consecutive places, each
block returns a query's best candidates by exact inner product, and the lists of all
orderings merge into the final ranking. A block that many queries reach meets them in
salted groups of bounded size.

How wide windows must be depends on the data, not on the number of rows alone:
vectors without any structure need windows over most of an ordering. ``calibrate``
therefore measures recall on a bounded set of queries, searched against all rows in
blocks, and takes the narrowest window share of a fixed ladder that reaches the
target on these. The same rule holds at every size.

Vectors that are null, zero, of another dimension than the table's or hold null or
non-finite components take no part, neither as query nor as candidate; nor do rows
with a null id. Repeated ids count as different candidates, but a query never returns
its own id. Other columns of the input, of whatever name, are left out. Ties go to the smaller id. With fewer candidates than k, all come back. An
empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table
from .embedding_dedup import matrix, usable

K = 20
QUERY_EVERY = 20
#: Orderings, dimensions of each projection, and bits a dimension (curve keys fit a signed long).
CURVES = 4
DIMENSIONS = 8
BITS = 7
#: Window half-widths as shares of all rows, tried from the narrowest; 1 covers an ordering.
LADDER = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 1.0)
TARGET = 0.94
#: Queries on which windows are calibrated, and vectors from which projections are fitted, about.
CALIBRATION = 100
SAMPLE = 5000
#: Consecutive places that one block holds.
BLOCK = 8192
#: Queries that meet a block in one group, about.
ASKED = 4096
SEED = 7


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of whole-number coordinates on the Hilbert curve of its cube.

    The transform by bit planes: reflect and exchange the low bits of the axes from the
    top plane down, Gray-encode across axes, and interleave the planes.
    """
    x = grid.astype(np.int64).T.copy()
    n = len(x)
    plane = 1 << (bits - 1)
    while plane > 1:
        low = plane - 1
        for i in range(n):
            up = (x[i] & plane) != 0
            mixed = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, mixed)
            x[i] ^= mixed
        plane >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, plane = np.zeros_like(x[0]), 1 << (bits - 1)
    while plane > 1:
        flip ^= np.where((x[n - 1] & plane) != 0, plane - 1, 0)
        plane >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """Projections, scales and shifts of all orderings, fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, dimensions: int = DIMENSIONS, bits: int = BITS):
        rnd = np.random.default_rng(SEED)
        width = sample.shape[1]
        self.mean = sample.mean(0)
        _, axes = np.linalg.eigh((sample - self.mean).T @ (sample - self.mean))
        axes = axes[:, ::-1]
        used = min(dimensions, width)
        self.bits = bits
        self.projections, self.low, self.step = [], [], []
        for c in range(curves):
            first = (c * used) % width  # principal dimensions in turn, so that orderings see different ones
            chosen = axes[:, [(first + i) % width for i in range(used)]]
            turn = np.linalg.qr(rnd.normal(size=(used, used)))[0]
            p = (sample - self.mean) @ chosen @ turn
            lo, hi = p.min(0), p.max(0)
            span = np.maximum(hi - lo, 1e-12)
            self.projections.append(chosen @ turn)
            self.low.append(lo - span * rnd.uniform(0.05, 0.45, used))  # the shift
            self.step.append((2**bits - 1) / (1.5 * span))

    def keys(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for p, lo, step in zip(self.projections, self.low, self.step, strict=True):
            grid = np.clip(((x - self.mean) @ p - lo) * step, 0, 2**self.bits - 1)
            out.append(hilbert_keys(grid.astype(np.int64), self.bits))
        return out


def top_k(query: np.ndarray, ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best entries in order; entries of the same row count once."""
    order = np.lexsort((rows, ids, -scores, query))
    q, r = query[order], rows[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (r[1:] != r[:-1])  # one row's score and id are the same in every list
    order, q = order[fresh], q[fresh]
    starts = np.flatnonzero(np.diff(q, prepend=-1))
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return order[rank < k]


def nearest(queries: np.ndarray, own: np.ndarray, candidates: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best candidates other than its own row: places of query and candidate, scores."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, (1 << 21) // max(1, len(ids)))
    for i in range(0, len(queries), step):
        scores = queries[i : i + step] @ candidates.T
        scores[own[i : i + step][:, None] == rows] = -np.inf
        at = max(0, len(ids) - k)
        least = np.partition(scores, at, axis=1)[:, at] if len(ids) else np.zeros(len(scores))
        q, c = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        s = scores[q, c]
        keep = top_k(q, ids[c], rows[c], s, k)
        out.append((q[keep] + i, c[keep], s[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)


LISTS = "q_row long, query_id long, ids array<long>, rows array<long>, scores array<double>"


def as_lists(q_row: np.ndarray, q_id: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> pa.Table:
    """One row a query with its candidates as lists; q is ascending."""
    seen, starts = np.unique(q, return_index=True)
    off = pa.array(np.append(starts, len(q)), pa.int32())
    lists = [pa.ListArray.from_arrays(off, pa.array(x)) for x in (ids, rows, scores)]
    return pa.table([pa.array(q_row[seen]), pa.array(q_id[seen]), *lists], ["q_row", "query_id", "ids", "rows", "scores"])


def search_windows(asked: DataFrame, members: DataFrame, on: list[str], k: int) -> DataFrame:
    """Best candidates of each (query, block) as lists, computed where queries and block meet."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, rows = right["id"].to_numpy(), right["row"].to_numpy()
        q_row, q_id = left["q_row"].to_numpy(), left["query_id"].to_numpy()
        if not len(ids) or not len(q_row):
            q = c = np.zeros(0, np.int64)
            return as_lists(q_row, q_id, q, q, q, np.zeros(0))
        q, c, scores = nearest(matrix(left["q_vector"]), q_row, matrix(right["vector"]), ids, rows, k)
        return as_lists(q_row, q_id, q, ids[c], rows[c], scores)

    return asked.groupBy(*on).cogroup(members.groupBy(*on)).applyInArrow(search, LISTS)


def merge_lists(lists: DataFrame, k: int, groups: int) -> DataFrame:
    """(q_row, query_id, rank, vec_id, row, score): the k best of all lists of each query."""

    def merge(part: pa.Table) -> pa.Table:
        sizes = np.diff(part["ids"].combine_chunks().offsets.to_numpy()) if len(part) else np.zeros(0, np.int64)
        ids, rows, scores = (part[c].combine_chunks().flatten().to_numpy() for c in ("ids", "rows", "scores"))
        q_row, q_id = (np.repeat(part[c].to_numpy(), sizes) for c in ("q_row", "query_id"))
        keep = top_k(q_row, ids, rows, scores, k)
        q = q_row[keep]
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q)))) + 1
        return pa.table([pa.array(q), pa.array(q_id[keep]), pa.array(rank, pa.int32()), pa.array(ids[keep]), pa.array(rows[keep]), pa.array(scores[keep])], ["q_row", "query_id", "rank", "vec_id", "row", "score"])

    dealt = lists.groupBy(F.pmod(F.xxhash64("q_row"), F.lit(groups)).alias("g"))
    return dealt.applyInArrow(merge, "q_row long, query_id long, rank int, vec_id long, row long, score double")


def order_rows(members: DataFrame, curves: Curves, n: int, block: int) -> DataFrame:
    """(curve, place, row, id, vector): every row's place from 0 in every ordering."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, keys in enumerate(curves.keys(matrix(batch.column("vector")))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), c), pa.int32()), pa.array(keys), *batch.columns], ["curve", "key", "row", "id", "vector"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            curve = batch.column("curve").to_numpy()
            nth = np.zeros(len(curve), np.int64)
            for c in np.unique(curve):
                own = np.flatnonzero(curve == c)
                nth[own] = np.arange(len(own)) + seen.get(int(c), 0)
                seen[int(c)] = seen.get(int(c), 0) + len(own)
            yield pa.RecordBatch.from_arrays([batch.column("curve"), pa.array(np.full(len(curve), part), pa.int32()), pa.array(nth), *(batch.column(c) for c in ("row", "id", "vector"))], ["curve", "part", "nth", "row", "id", "vector"])

    parts = max(1, -(-n * len(curves.projections) // (2 * block)))
    keyed = members.mapInArrow(key, "curve int, key long, row long, id long, vector array<double>")
    sorted_ = keyed.repartitionByRange(parts, "curve", "key", "row").sortWithinPartitions("curve", "key", "row")
    numbered = cut(sorted_.mapInArrow(number, "curve int, part int, nth long, row long, id long, vector array<double>"))
    before = F.coalesce(F.sum("count").over(W.partitionBy("curve").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = numbered.groupBy("curve", "part").count().select("curve", "part", before.alias("first"))  # a row a partition
    return numbered.join(F.broadcast(firsts), ["curve", "part"]).select("curve", (F.col("nth") + F.col("first")).alias("place"), "row", "id", "vector")


def calibrate(placed: DataFrame, members: DataFrame, queries: DataFrame, n: int, k: int, target: float) -> tuple[float, float]:
    """Narrowest window share of the ladder whose recall on a bounded set of queries reaches the target, and that recall."""
    n_queries = queries.count()
    share = int(min(1.0, CALIBRATION / max(1, n_queries)) * (1 << 30))
    got = queries.where(F.pmod(F.xxhash64("row", F.lit(11)), F.lit(1 << 30)) < share).limit(4 * CALIBRATION).toArrow()
    if not len(got):
        return LADDER[-1], 1.0
    own, q_id, vectors = got["row"].to_numpy(), got["id"].to_numpy(), matrix(got["vector"])

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("id").to_numpy(), batch.column("row").to_numpy()
            q, c, scores = nearest(vectors, own, matrix(batch.column("vector")), ids, rows, k)
            yield from as_lists(own, q_id, q, ids[c], rows[c], scores).to_batches()

    truth = merge_lists(members.mapInArrow(brute, LISTS), k, CALIBRATION).select("q_row", "row").toArrow()  # bounded: queries times k
    pairs = list(zip(truth["q_row"].to_pylist(), truth["row"].to_pylist(), strict=True))
    wanted = members.sparkSession.createDataFrame([(r,) for r in {x for p in pairs for x in p}], "row long")
    places: dict[int, dict[int, int]] = {}
    for r in placed.join(F.broadcast(wanted), "row").select("curve", "place", "row").collect():
        places.setdefault(r.row, {})[r.curve] = r.place
    apart = np.array([min(abs(places[a][c] - places[b][c]) for c in places[a]) for a, b in pairs])
    for width in LADDER:
        recall = float((apart <= width * n).mean()) if len(apart) else 1.0
        if recall >= target:
            break
    return width, recall


def nearest_neighbours(df: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, dimensions: int = DIMENSIONS, block: int = BLOCK, target: float = TARGET, width: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of ``df`` for which ``is_query`` holds.

    ``width`` fixes the window (a share of the rows on either side) instead of calibrating it.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable("vector"))
    sizes = rows.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    members = cut(rows.where(F.size("vector") == (sizes[0].w if sizes else -1)).withColumn("row", F.monotonically_increasing_id()))
    n = members.count()
    asks, members = members.where("asks").select("row"), members.select("row", "id", "vector")
    sample = matrix(members.where(F.pmod(F.xxhash64("row", F.lit(5)), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 30))).select("vector").toArrow()["vector"])
    fitted = Curves(sample if len(sample) else np.zeros((1, sizes[0].w if sizes else 1)), curves, dimensions)
    placed = cut(order_rows(members, fitted, n, block))
    asked = placed.join(asks, "row", "left_semi")
    if width is None:
        width, _ = calibrate(placed, members, asked.where("curve = 0").select("row", "id", "vector"), n, k, target)
    reach, last = F.lit(int(np.ceil(width * n))), F.lit(max(0, n - 1))
    covered = F.sequence(F.floor(F.greatest(F.col("place") - reach, F.lit(0)) / block), F.floor(F.least(F.col("place") + reach, last) / block))
    groups = max(1, math.ceil(asked.where("curve = 0").count() * min(1.0, 2 * width + block / max(1, n)) / ASKED))
    windows = asked.select((F.col("curve") + 0).alias("curve"), F.explode(covered).alias("block"), F.col("row").alias("q_row"), F.col("id").alias("query_id"), F.col("vector").alias("q_vector"), F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("salt"))
    dealt = placed.withColumn("block", F.floor(F.col("place") / block)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    lists = search_windows(windows, dealt, ["curve", "block", "salt"], k)
    return merge_lists(lists, k, max(1, n // 20_000)).select("query_id", "rank", "vec_id", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)
