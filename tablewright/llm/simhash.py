"""SimHash near-duplicates with vantage-point trees over Hamming distance.

A fingerprint takes the majority of each bit over the XXH64 hashes of the text's word
shingles. Equal fingerprints collapse first, so groups of copies of any size cost one
row. A shallow vantage-point tree, fitted on a bounded sample, deals the distinct
fingerprints to shards; a fingerprint also visits every other shard that its ball of
``radius`` bits overlaps by the triangle bounds. Inside a shard, a vantage-point tree
joins residents with residents and visitors: a branch is walked only with the queries
whose bounds reach it, and leaves compare exactly. A shard's visitors come in salted groups of bounded size, each
with all residents. A task returns a spanning forest of
its links rather than all pairs, and the forests meet in connected_components.

Null and empty texts have fingerprint 0, linked like any other; texts of any length are
read whole. Other columns of the input, of whatever name, are left out. Rows with a null id
get their fingerprint's component but join nothing on their own. Repeated rows come
back repeated; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, cut, table, text_array
from .components import Forest, connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Distinct fingerprints that a shard is at home to, and the least depth of the tree of shards.
SHARD = 100_000
LEAST_DEPTH = 3
#: Visitors that one group of a shard holds, about.
VISITORS = 50_000
#: Fingerprints from which the tree of shards is fitted.
SAMPLE = 4096
LEAF = 256
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of the text's word shingles, repeats included."""
    import xxhash

    words = text.encode().lower().split()
    if len(words) > size:
        words = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    elif words:
        words = [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint an array: bit i is set in over half of its hashes."""
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(hashes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    n, flat = sizes[some], np.concatenate([hashes[i] for i in some])
    runs = (n + 254) // 255  # byte lanes hold 255 counts
    first = np.cumsum(n) - n
    run_of = np.repeat(np.arange(len(some)), runs)
    run_first = np.cumsum(runs) - runs
    starts = first[run_of] + 255 * (np.arange(runs.sum()) - run_first[run_of])
    for k in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(k)) & _LANES, starts).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(lanes.astype(np.int64), run_first, axis=0)
        for j in range(8):
            out[some] |= (2 * counts[:, j] > n).astype(np.uint64) << np.uint64(8 * j + k)
    return out


def fingerprints(df: DataFrame, shingle: int = SHINGLE, text_col: str = "text") -> DataFrame:
    """``df`` with its fingerprint as a long (the 64 bits, signed)."""

    def start():
        def work(column: pa.Array) -> list[pa.Array]:
            made = majority([shingle_hashes(t, shingle) for t in text_array(column).to_pylist()])
            return [pa.array(made.view(np.int64))]

        return work

    return append_columns(df, start, [T.StructField("fp", T.LongType())], text_col)


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def fit_shards(sample: np.ndarray, depth: int) -> list[tuple[np.uint64, int]]:
    """Vantage points and radii of a complete tree, node i above 2i + 1 and 2i + 2."""
    nodes: list[tuple[np.uint64, int]] = []
    parts = [sample]
    for _ in range(depth):
        below = []
        for part in parts:
            vp = part[len(part) // 2] if len(part) else np.uint64(len(nodes))
            d = distance(part, vp)
            mu = int(np.median(d)) if len(d) else 32
            nodes.append((vp, mu))
            below += [part[d <= mu], part[d > mu]]
        parts = below
    return nodes


def route(fps: np.ndarray, nodes: list[tuple[np.uint64, int]], depth: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``fps``, the shards they live in or visit, and whether they live there."""
    at = [(0, np.arange(len(fps)), np.ones(len(fps), bool))]
    for _ in range(depth):
        below = []
        for node, rows, home in at:
            vp, mu = nodes[node]
            d = distance(fps[rows], vp)
            near, far = d <= mu + radius, d > mu - radius
            below += [(2 * node + 1, rows[near], home[near] & (d[near] <= mu)), (2 * node + 2, rows[far], home[far] & (d[far] > mu))]
        at = below
    rows, home = np.concatenate([x[1] for x in at]), np.concatenate([x[2] for x in at])
    return rows, np.repeat(np.arange(len(at)), [len(x[1]) for x in at]), home


def link_within(fps: np.ndarray, home: np.ndarray, radius: int, asks: np.ndarray | None = None) -> Forest:
    """Links of the residents with those that ask (all, unless said), found by a vantage-point tree."""
    forest = Forest(len(fps))
    stack = [(np.flatnonzero(home), np.arange(len(fps)) if asks is None else np.flatnonzero(asks))]
    while stack:
        x, q = stack.pop()
        if not len(x) or not len(q) or forest.joined(x, q):
            continue
        if len(x) > LEAF:
            vp = fps[x[len(x) // 2]]
            dx, dq = distance(fps[x], vp), distance(fps[q], vp)
            mu = int(np.median(dx))
            mu -= (dx <= mu).all()
            inside = dx <= mu
            if inside.any():
                stack.append((x[inside], q[dq <= mu + radius]))
                stack.append((x[~inside], q[dq > mu - radius]))
                continue
        step = max(1, (1 << 19) // len(x))
        own = fps[x]
        for i in range(0, len(q), step):
            part = q[i : i + step]
            i_q, i_x = np.nonzero(distance(fps[part][:, None], own) <= radius)
            if len(i_q) > len(part):  # more than each resident query with itself
                forest.add(part[i_q], x[i_x])
            elif len(i_q):
                pairs = part[i_q] != x[i_x]
                forest.add(part[i_q][pairs], x[i_x][pairs])
    return forest


def fingerprint_links(reps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): a spanning forest of the pairs within ``radius`` bits among rows (rep, fp) with distinct fps."""
    n = reps.count()
    depth = max(LEAST_DEPTH, math.ceil(math.log2(max(1, n / SHARD))))
    share = min(1.0, SAMPLE / max(1, n))
    sample = reps.where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30))).select("fp").toArrow()["fp"].to_numpy()
    nodes = fit_shards(np.sort(sample.view(np.uint64) if len(sample) else np.zeros(1, np.uint64)), depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, shard, home = route(batch.column("fp").to_numpy().view(np.uint64), nodes, depth, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *(c.take(pa.array(rows)) for c in batch.columns), pa.array(home)], ["shard", "fp", "rep", "home"])

    def join(part: pa.Table) -> pa.Table:
        fps, rep = part["fp"].to_numpy().view(np.uint64), part["rep"].to_numpy()
        home = part["home"].to_numpy()
        first = bool(len(part)) and part["salt"][0].as_py() == 0  # residents meet each other in one group
        child, parent = link_within(fps, home, radius, None if first else ~home).links()
        return pa.table({"a": pa.array(rep[child]), "b": pa.array(rep[parent])})

    dealt = reps.where("rep IS NOT NULL").select("fp", "rep").mapInArrow(deal, "shard int, fp long, rep long, home boolean")
    groups = dealt.groupBy("shard").agg((F.count_if(~F.col("home")) / VISITORS).cast("int").alias("last"))  # a row a shard
    dealt = dealt.join(groups, "shard")
    salts = F.when(F.col("home"), F.sequence(F.lit(0), F.col("last"))).otherwise(F.array(F.pmod(F.xxhash64("fp", F.lit(9)), F.col("last") + 1).cast("int")))
    return dealt.select("shard", "fp", "rep", "home", F.explode(salts).alias("salt")).groupBy("shard", "salt").applyInArrow(join, "a long, b long")


def simhash_components(df: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row; ids must be whole numbers."""
    rows = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    marked = cut(fingerprints(rows, shingle).select(id_col, "fp"))
    reps = cut(marked.groupBy("fp").agg(F.min(id_col).alias("rep")))
    found = connected_components(fingerprint_links(reps, radius)).withColumnRenamed("node", "rep")
    classes = reps.join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(classes, "fp").select(id_col, "fp", "component_id")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
