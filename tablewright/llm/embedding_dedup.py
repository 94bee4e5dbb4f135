"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine c are sqrt(2 - 2c) apart, so the cosine bound becomes a
distance epsilon. Within a label (distances do not change when its mean is taken
away) the vectors are projected on leading principal dimensions, cut into grid cells
of width epsilon and sorted by cell: the epsilon grid order. The sequence is dealt
into intervals of bounded length. Two intervals can only hold a link if the boxes
around their projections (with the length of what the projection leaves out as one
more dimension) come within epsilon. Interval pairs meet by an equality join on the
first two grid dimensions, widened by epsilon, and are skipped if their boxes are too
far apart. ``RUN`` consecutive intervals travel together, so that an interval goes once
to each run it has a partner in, not once to each partner. A pair of intervals is joined recursively: halves that are provably distant
are skipped, small blocks are compared exactly by cosine in double precision on the
original vectors.

Equal vectors of a label collapse first; a class of copies counts with its size. A
task returns how many vectors each class is linked to and a spanning forest of the
links, never all pairs.

Null labels and vectors that are null, zero, of another dimension than the table's or
hold null or non-finite components link with nothing: n_links 0, component_id their
own id. Repeated rows count as different vectors; rows with a null id come back with
null component and kept and take no part. Other columns of the input, of whatever name,
are left out. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .components import Forest, connected_components

COSINE = 0.98
#: Leading principal dimensions of the grid.
DIMENSIONS = 8
#: Vectors from which means and principal dimensions are fitted, about.
SAMPLE = 20_000
#: Vectors in an interval of the sequence.
INTERVAL = 1024
LEAF = 64
#: Consecutive intervals that meet those of another run in one task.
RUN = 8


def usable(vector: str) -> Column:
    """Whether a vector has only finite components, and one that is not zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without nulls as rows in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x  # no overflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_axes(rows: DataFrame, n: int, dimensions: int, sample: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Each label's mean and the principal axes of what is left, from a bounded sample."""
    share = int(min(1.0, sample / max(1, n)) * (1 << 30))
    got = rows.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 30)) < share).select("label", "vector").toArrow()
    x, labels = unit(matrix(got["vector"])), got["label"].to_numpy()
    if not len(x):
        return {}, np.zeros((0, 0))
    means = {int(k): x[labels == k].mean(0) for k in np.unique(labels)}
    x = x - np.array([means[int(k)] for k in labels])
    _, axes = np.linalg.eigh(x.T @ x)
    return means, axes[:, ::-1][:, : min(dimensions, x.shape[1])]


def project(x: np.ndarray, labels: np.ndarray, means: dict[int, np.ndarray], axes: np.ndarray) -> np.ndarray:
    """Leading coordinates, and the length of the rest as a last one; distances never grow."""
    zero = np.zeros(x.shape[1])
    x = unit(x) - np.array([means.get(int(k), zero) for k in labels]).reshape(len(x), -1)
    lead = x @ axes
    rest = np.sqrt(np.maximum((x * x).sum(1) - (lead * lead).sum(1), 0))
    return np.column_stack([lead, rest])


def join_intervals(a: np.ndarray, b: np.ndarray, same: bool, unit_rows: np.ndarray, coords: np.ndarray, weight: np.ndarray, cosine: float, links: np.ndarray, forest: Forest) -> None:
    """Recursive join of two row ranges: counts into ``links``, unions into ``forest``."""
    epsilon = np.sqrt(2 - 2 * cosine) + 1e-9
    stack = [(a, b, same)]
    while stack:
        a, b, same = stack.pop()
        if not same:
            pa_, pb = coords[a], coords[b]
            gap = np.maximum(0, np.maximum(pa_.min(0) - pb.max(0), pb.min(0) - pa_.max(0)))
            if (gap * gap).sum() > epsilon * epsilon:
                continue
        if max(len(a), len(b)) > LEAF:
            if same:
                h = len(a) // 2
                stack += [(a[:h], a[:h], True), (a[h:], a[h:], True), (a[:h], a[h:], False)]
            elif len(a) >= len(b):
                h = len(a) // 2
                stack += [(a[:h], b, False), (a[h:], b, False)]
            else:
                h = len(b) // 2
                stack += [(a, b[:h], False), (a, b[h:], False)]
            continue
        i, j = np.nonzero(unit_rows[a] @ unit_rows[b].T >= cosine)
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            np.add.at(links, a[i], weight[b[j]])
            np.add.at(links, b[j], weight[a[i]])
            forest.add(a[i], b[j])


def near_duplicate_embeddings(df: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", dimensions: int = DIMENSIONS, interval: int = INTERVAL, sample: int = SAMPLE) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    epsilon = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    kind = "array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"  # compared in double precision either way
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast(kind).alias("vector"))
    width = rows.where(usable("vector")).groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    taking_part = F.col("id").isNotNull() & F.col("label").isNotNull() & usable("vector") & (F.size("vector") == (width[0].w if width else -1))
    # 128 bits of hash name a class of equal vectors, so that vectors themselves need not travel as keys
    key = F.struct(F.xxhash64("label", "vector").alias("h"), F.xxhash64(F.lit(1), "vector", "label").alias("g"))
    keyed = rows.select("id", F.when(taking_part, F.col("label")).alias("label"), F.when(taking_part, F.col("vector")).alias("vector"))
    inside = keyed.where("vector IS NOT NULL").select("id", "label", "vector", key.alias("key"))
    classes = cut(inside.groupBy("key").agg(F.min(F.struct("id", "label", "vector")).alias("x"), F.count("*").alias("n")).select("key", "x.label", "x.vector", F.col("x.id").alias("rep"), "n"))
    n = classes.count()
    means, axes = fit_axes(classes, n, dimensions, sample)
    names = [f"p{i}" for i in range(axes.shape[1] + 1)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coords = project(matrix(batch.column("vector")), batch.column("label").to_numpy(), means, axes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(coords.tolist(), pa.list_(pa.float64()))], [*batch.schema.names, "coords"])

    placed = classes.select("label", "vector", "rep", "n").mapInArrow(place, f"label long, vector {kind}, rep long, n long, coords array<double>")
    cells = [F.floor(F.col("coords")[i] / epsilon) for i in range(len(names))]
    parts = max(1, -(-n // (16 * interval)))
    order = ["label", *(f"c{i}" for i in range(len(names))), "rep"]
    in_order = placed.select("*", *(c.alias(f"c{i}") for i, c in enumerate(cells))).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Intervals of consecutive rows; none holds two labels. A slice of the id space per task."""
        from pyspark import TaskContext

        nth, held, label = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            ids = []
            for k in batch.column("label").to_pylist():
                if held == interval or k != label:
                    nth, held, label = nth + 1, 0, k
                held += 1
                ids.append(nth)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(batch.column(c) for c in ("label", "rep", "n", "vector", "coords"))], ["block", "label", "rep", "n", "vector", "coords"])

    members = cut(in_order.mapInArrow(number, f"block long, label long, rep long, n long, vector {kind}, coords array<double>"))
    lows = [F.min(F.col("coords")[i]).alias(f"lo{i}") for i in range(len(names))]
    highs = [F.max(F.col("coords")[i]).alias(f"hi{i}") for i in range(len(names))]
    boxes = members.groupBy("label", "block").agg(*lows, *highs)
    keys = range(min(2, max(0, len(names) - 1)))

    def cell_range(i: int, widen: float) -> Column:
        return F.sequence(F.floor((F.col(f"lo{i}") - widen) / epsilon), F.floor((F.col(f"hi{i}") + widen) / epsilon))

    def keyed_by_cells(widen: float) -> DataFrame:
        out = boxes
        for i in keys:
            out = out.withColumn(f"k{i}", F.explode(cell_range(i, widen)))
        return out

    on = ["label", *(f"k{i}" for i in keys)]
    left = keyed_by_cells(0.0)
    right = keyed_by_cells(epsilon).select(*on, F.col("block").alias("other"), *(F.col(f"{e}{i}").alias(f"{e}{i}_") for e in ("lo", "hi") for i in range(len(names))))
    gap2 = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"lo{i}_") - F.col(f"hi{i}"), F.col(f"lo{i}") - F.col(f"hi{i}_")), 2) for i in range(len(names))), F.lit(0.0))
    block_pairs = cut(left.join(right, on).where((F.col("block") <= F.col("other")) & (gap2 <= epsilon * epsilon)).select("block", "other").distinct().select("block", "other", F.expr(f"block div {RUN}").alias("run"), F.expr(f"other div {RUN}").alias("with")))

    sides = block_pairs.select("run", "with", F.explode(F.array_distinct(F.array("block", "other"))).alias("block")).distinct()
    dealt = sides.join(members, "block").select("run", "with", "block", "label", "rep", "n", "vector")

    def compare(part: pa.Table, pairs: pa.Table) -> pa.Table:
        rep, block, weight = (part[c].to_numpy() for c in ("rep", "block", "n"))
        x = matrix(part["vector"])
        coords, x = project(x, part["label"].to_numpy(), means, axes), unit(x)
        order_ = np.lexsort((rep, *(np.floor(coords[:, i] / epsilon) for i in reversed(range(coords.shape[1]))), block))
        of = block[order_]
        links, forest = np.zeros(len(rep), np.int64), Forest(len(rep))
        for one, other in sorted(zip(pairs["block"].to_pylist(), pairs["other"].to_pylist(), strict=True)):
            a, b = (order_[np.searchsorted(of, k) : np.searchsorted(of, k, side="right")] for k in (one, other))
            join_intervals(a, b, one == other, x, coords, weight, cosine, links, forest)
        child, parent = forest.links()
        hit = np.flatnonzero(links)
        none = np.full(len(hit), None)
        return pa.table(
            {
                "rep": pa.array(np.concatenate([rep[hit], rep[child]])),
                "links": pa.array(np.concatenate([links[hit], np.zeros(len(child), np.int64)])),
                "other": pa.array([*none, *rep[parent].tolist()], pa.int64()),
            }
        )

    met = dealt.groupBy("run", "with").cogroup(block_pairs.select((F.col("run") + 0).alias("run"), (F.col("with") + 0).alias("with"), "block", "other").groupBy("run", "with"))
    found = cut(met.applyInArrow(compare, "rep long, links long, other long"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "rep")
    answers = classes.select("key", "rep", "n").join(counts, "rep", "left").join(components, "rep", "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    alone = keyed.where("vector IS NULL").select("id", F.lit(0).alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    out = inside.select("id", "key").join(answers, "key", "left").select("id", "n_links", "component_id").unionAll(alone)
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_embeddings(table(spark, sf_dir, "embeddings"))
