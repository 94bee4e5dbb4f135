"""Packing documents into fixed-length sequences by cutting-stock column generation.

1. Documents become token ids and an end id. Whole pieces of the sequence length are
   cut off first; what remains of a document is its last piece. So pieces, and the
   checksums of their ids, depend on their own document alone, and only their lengths
   travel on.
2. Lengths are counted by class (``GRAIN`` tokens wide, so at most capacity / GRAIN
   rows reach the driver, whatever the input). The linear program over patterns of
   classes is solved by column generation: duals price the classes, an unbounded
   knapsack finds the best new pattern by dynamic programming, a simplex pivot lets it
   in, as it does columns that let a larger class's place hold a smaller one. A knapsack of worth w proves that no packing of classes takes less than the
   present sequences divided by w; columns enter until that bound is within ``GAP`` (or
   numbers no longer allow a pivot: the last sound basis is a valid packing).
3. Patterns are rounded down; the rest of each class is packed first-fit decreasing.
4. Pieces are ranked inside their class, in salted groups (about as many of them as
   pieces in each), and the rank picks pattern, sequence and slot by binary search in
   the pattern table, which has under (classes + 1)^2 rows whatever the input.

Null texts count as empty; an empty document is its end id alone. Repeated rows are
packed one by one; equal lengths are told apart by id, start and checksum, and pieces
that tie in all of these are alike. The result has the columns named above it alone:
other columns of the input, of whatever name, are left out. An empty table gives an
empty table.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, cut, spans_of, table, text_array
from .pretokens import Memo, Pretokens, default_path, ids_of_words, load

CAPACITY = 2048
END_ID = 1
#: Width of a length class in tokens (its common divisor with the sequence length is used); a piece wastes less than this.
GRAIN = 8
#: Sequences that the linear program may stay above its proven bound, as a share.
GAP = 1e-5
#: Least pivot, as a share of the entering column's largest entry.
PIVOT = 1e-7
#: Pivots between fresh inversions of the basis, and the residual (as a share of the largest demand) that calls for one at once.
REFRESH, RESIDUAL = 25, 1e-9
#: Pieces of one class that one ranking group holds at least.
RANKED = 500

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens), one row a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, added = load(vocabulary or default_path("byte_bpe_50k.json"))
        split = Pretokens(added)
        ids_of = ids_of_words(tokenizer, added)
        memo = Memo(lambda words: [array("I", ids).tobytes() for ids in ids_of(words)])
        end = array("I", [end_id]).tobytes()
        for batch in batches:
            for part in blocks(batch, "text", BLOCK_BYTES):
                texts = text_array(part.column("text")).to_pylist()
                split_texts = [split(t) for t in texts]
                ids = memo.lookup([w for words in split_texts for w in words])
                lengths, sums, at = [], [], 0
                for words in split_texts:
                    data = memoryview(b"".join(ids[at : at + len(words)]) + end)
                    at += len(words)
                    lengths.append(len(data) // 4)
                    sums += [zlib.crc32(data[i : i + 4 * capacity]) for i in range(0, len(data), 4 * capacity)]
                total = np.array(lengths, np.int64)
                n = -(-total // capacity)
                of = np.repeat(np.arange(len(n)), n)
                start = capacity * spans_of(np.zeros(len(n), np.int64), n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(of)), pa.array(start), pa.array(np.minimum(total[of] - start, capacity)), pa.array(np.array(sums, np.int64)), pa.array(total[of])],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES)


def knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most value of items of sizes 1..len(values) within capacity, each usable again; its counts."""
    m = len(values)
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        k = min(m, c)
        gains = values[:k] + best[c - k : c][::-1]
        i = int(gains.argmax())
        best[c], took[c] = (gains[i], i + 1) if gains[i] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    counts, c = np.zeros(m, np.int64), capacity
    while c > 0:
        if took[c]:
            counts[took[c] - 1] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[capacity]), counts


def first_columns(need: np.ndarray, rows: np.ndarray, capacity: int) -> np.ndarray:
    """A pattern a class: the class itself, then as much of smaller ones as lasts for all its
    sequences. A class of which hardly a piece is left stands alone: it would only blur the basis."""
    left, columns = need.copy(), np.zeros((capacity, len(rows)))
    for k in range(len(rows) - 1, -1, -1):
        most = capacity // (rows[k] + 1)
        if left[k] < 0.05:
            columns[rows[k], k] = most
            continue
        n = max(1, min(most, int(left[k])))
        runs, room = left[k] / n, capacity - n * (rows[k] + 1)
        columns[rows[k], k], left[k] = n, 0
        for j in range(k - 1, -1, -1):
            n = min(room // (rows[j] + 1), int(left[j] / runs))
            columns[rows[j], k] = n
            room -= n * (rows[j] + 1)
            left[j] -= n * runs
    return columns


class Basis:
    """Columns in use, one a class with demand: their inverse and how often each is used.

    A column is a pattern, which costs one sequence, or an exchange (1 for a class, -1 for
    the next larger one, free): a place for the larger may hold the smaller.
    """

    def __init__(self, columns: np.ndarray, rows: np.ndarray, need: np.ndarray):
        self.columns, self.rows, self.need = columns, rows, need
        self.refresh()

    def refresh(self) -> None:
        self.square = self.columns[self.rows]
        self.inverse = np.linalg.inv(self.square)
        self.inverse += self.inverse @ (np.eye(len(self.rows)) - self.square @ self.inverse)  # one step of refinement
        self.use = self.inverse @ self.need
        self.age = 0

    @property
    def duals(self) -> np.ndarray:
        return (self.columns.min(0) >= 0).astype(float) @ self.inverse

    @property
    def residual(self) -> float:
        """Pieces that the basis misses or invents, as a share of the largest demand."""
        return float(np.abs(self.square @ np.maximum(self.use, 0) - self.need).max() / self.need.max())

    def pivot(self, column: np.ndarray) -> bool:
        """Let a column in for the one that runs out first; False if no pivot is large enough."""
        enter = self.inverse @ column[self.rows]
        ok = enter > PIVOT * max(1.0, float(np.abs(enter).max()))
        if not ok.any():
            return False
        ratio = np.where(ok, np.maximum(self.use, 0) / np.where(ok, enter, 1), np.inf)
        near = ratio <= ratio.min() * (1 + 1e-9) + 1e-12
        leave = int(np.where(near, enter, 0).argmax())  # among equal ratios the largest pivot
        self.columns[:, leave] = column
        self.square = self.columns[self.rows]
        self.age += 1
        if self.age >= REFRESH:
            self.refresh()
            return True
        self.inverse[leave] /= enter[leave]
        others = np.arange(len(self.rows)) != leave
        self.inverse[others] -= np.outer(enter[others], self.inverse[leave])
        self.use = self.inverse @ self.need
        if self.residual > RESIDUAL:
            self.refresh()
        return True


def solve_patterns(demand: np.ndarray, gap: float = GAP) -> list[tuple[np.ndarray, float]]:
    """Columns (patterns and exchanges) and their use in the linear program: least sequences for the demand.

    ``demand[i]`` pieces have size i + 1; a sequence holds len(demand). Demands are spread
    by distinct shares below half a millionth of a piece, so that bases do not tie and no
    basis comes twice; the answer meets the demand to that share. Exchanges keep the duals
    in order of size, which spares most of the columns.
    """
    capacity, rows = len(demand), np.flatnonzero(demand)
    if not len(rows):
        return []
    need = demand[rows] + 5e-7 * np.random.default_rng(1).random(len(rows))
    single = np.zeros((capacity, len(rows)))
    single[rows, np.arange(len(rows))] = capacity // (rows + 1)  # as many of one class as a sequence holds: always sound
    basis = Basis(first_columns(need, rows, capacity), rows, need)
    if basis.residual > RESIDUAL:
        basis = Basis(single.copy(), rows, need)
    sound = basis.columns.copy()
    try:
        while True:
            duals, column = basis.duals, np.zeros(capacity)
            drop = duals[:-1] - duals[1:]
            if len(drop) and drop.max() > 1e-7:
                k = int(drop.argmax())
                column[rows[k]], column[rows[k + 1]] = 1, -1
            else:
                values = np.zeros(capacity)
                values[rows] = np.maximum(duals, 0)
                worth, column = knapsack(values, capacity)
                column = np.where(demand > 0, column, 0)
                if worth <= 1 + gap:
                    break
            if not basis.pivot(column):
                break
            if basis.age == 0:  # freshly inverted
                if basis.residual > 1e-7:
                    break
                sound = basis.columns.copy()
    except np.linalg.LinAlgError:
        pass
    for columns in (basis.columns, sound, single):
        try:
            last = Basis(columns.copy(), rows, need)
        except np.linalg.LinAlgError:
            continue
        if last.residual <= 1e-7:
            break
    return [(last.columns[:, j].astype(np.int64), float(last.use[j])) for j in range(len(rows)) if last.use[j] > 0]


def fill(pattern: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The pattern with places whose class is used up given to the next smaller class that is left."""
    out = np.zeros_like(pattern)
    for slot in np.flatnonzero(pattern)[::-1]:
        places, c = int(pattern[slot]), int(slot)
        while places and c >= 0:
            n = min(places, int(left[c] - out[c]))
            out[c] += n
            places -= n
            c -= 1
    return out


def plan(demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole numbers of sequences that together hold exactly the demand."""
    left, out = demand.copy(), []
    for pattern, x in sorted(((p, x) for p, x in solve_patterns(demand) if p.min() >= 0), key=lambda p: -p[1]):
        runs = int(x + 1e-5)
        while runs:
            filled = fill(pattern, left)
            used = filled > 0
            if not used.any():
                break
            n = min(runs, int((left[used] // filled[used]).min()))
            out.append((filled, n))
            left -= n * filled
            runs -= n
    open_: list[list[int]] = []
    room = np.zeros(0, np.int64)
    for size in range(len(demand), 0, -1):  # first-fit decreasing; a class leaves few pieces
        for _ in range(int(left[size - 1])):
            fits = np.flatnonzero(room >= size)
            if len(fits):
                i = int(fits[0])
                open_[i].append(size)
            else:
                i = len(open_)
                open_.append([size])
                room = np.append(room, len(demand))
            room[i] -= size
    seen: dict[tuple[int, ...], int] = defaultdict(int)
    for sizes in open_:
        seen[tuple(sizes)] += 1
    for sizes, n in seen.items():
        out.append((np.bincount(np.array(sizes) - 1, minlength=len(demand)), n))
    return out


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The plan of a demand as rows: class, its first rank in a pattern, pieces a sequence, first sequence.

    In a task, where numpy has one thread: with several, the linear algebra of a driver
    may hang, and its last digits differ from machine to machine.
    """
    for batch in batches:
        for demand in batch.column("demand").to_pylist():
            rows, taken, base = [], [0] * len(demand), 0
            for pattern, n in plan(np.array(demand, np.int64)):
                for i in np.flatnonzero(pattern).tolist():
                    rows.append((i + 1, taken[i], int(pattern[i]), base))
                    taken[i] += int(pattern[i]) * n
                base += n
            cols = np.array(sorted(rows), np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["class", "first", "each", "base"])


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of ``cut_pieces`` with sequence_id and offset."""
    spark, grain = docs.sparkSession, math.gcd(capacity, GRAIN)
    width = capacity // grain
    cls = F.ceil(F.col("length") / grain).cast("int")
    pieces = cut(cut_pieces(docs, vocabulary, capacity, end_id, id_col, text_col).withColumn("class", cls))
    counted = {r["class"]: r.n for r in pieces.groupBy("class").agg(F.count("*").alias("n")).collect()}  # at most ``width`` rows
    demand = np.zeros(width, np.int64)
    for c, n in counted.items():
        demand[c - 1] = n
    asked = spark.createDataFrame([(demand.tolist(),)], "demand array<long>")
    got = asked.mapInArrow(_solve, "class long, first long, each long, base long").toArrow()  # under (width + 1)^2 rows
    by_rank = np.column_stack([got[c].to_numpy() for c in got.column_names]).reshape(-1, 4)
    bounds = np.searchsorted(by_rank[:, 0], np.arange(width + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            sequence = np.zeros(len(cls), np.int64)
            for c in np.unique(cls):
                own, part = np.flatnonzero(cls == c), by_rank[bounds[c] : bounds[c + 1]]
                _, lo, each, first = part[np.searchsorted(part[:, 1], rank[own], side="right") - 1].T
                sequence[own] = first + (rank[own] - lo) // each
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sequence), batch.column("rank")], [*batch.schema.names[:-2], "sequence_id", "rank"])

    # of a class of n pieces, about sqrt(n) groups of sqrt(n)
    salts = F.broadcast(spark.createDataFrame([(c, max(1, int(-(-n // max(RANKED, math.isqrt(n)))))) for c, n in counted.items()], "class int, salts int"))
    ranked = pieces.join(salts, "class").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("salts")).cast("int"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("class").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = ranked.groupBy("class", "salt").agg(F.count("*").alias("n")).select("class", "salt", before.alias("first"))
    order = W.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = ranked.withColumn("at", F.row_number().over(order) - 1).join(firsts, ["class", "salt"])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = ranked.select(*names, "class", (F.col("at") + F.col("first")).alias("rank")).mapInArrow(place, f"{PIECES}, sequence_id long, rank long")
    slots = W.partitionBy("sequence_id").orderBy(F.desc("length"), "rank").rowsBetween(W.unboundedPreceding, -1)
    return placed.select(*names, "sequence_id", F.coalesce(F.sum("length").over(slots), F.lit(0)).alias("offset"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
