"""Target-distribution importance resampling: documents drawn as if from the benchmark's distribution.

1. Tasks count hashed features of the corpus and of the target texts into arrays of
   ``buckets`` counters; the arrays meet by bucket, so the driver sees one number a
   bucket and side, whatever the corpus holds.
2. A bucket's gain (scaled log ratio of smoothed shares) is one entry of an array that
   every task has; a document's weight is the floored mean of its features' gains.
3. Gumbel noise from the document's id makes a draw without replacement of a top-k.
   The k-th score comes from a histogram of the integer scores: counts summed from the
   top give each score the rank before its first row, and the cutoff score. Only rows at
   or above the cutoff are ordered, each score by itself, by id.

A feature is a run of 1 to ``max_run`` words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
after lower-casing A-Z), joined by one space; runs overlap and repeats count.

Edge cases: null and empty texts have no feature and weight 0; they are never drawn
(``min_words``) unless that is 0. Texts of any length are read whole. Repeated rows are
drawn one by one, in no fixed order among equal ids and scores. A null id takes its noise
from the seed alone (``"2024:"``) and comes last in its score. An empty corpus gives an
empty table, an empty target the same gain law with no counts. Columns of the input that
have a result column's name are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, blocks, cut, string_buffers, table, text_array

BUCKETS, MAX_RUN, SEED, MIN_WORDS, PERCENT = 10_000, 1, "2024", 20, 10
BLOCK = 1 << 20
#: Features longer than this are hashed one by one, all others in step.
IN_STEP = 48


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


CRC = _crc_table()
_BYTE = np.arange(256)
#: Lower case of every byte, and whether it belongs to a word: digits, letters, all of a multi-byte character.
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
IN_WORD = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)


def crc32_slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of data[start:end] for each slice; slices advance together, byte by byte."""
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    size = end - start
    order = np.argsort(-np.minimum(size, IN_STEP + 1), kind="stable")
    order = order[np.searchsorted(-size[order], -IN_STEP, "left") :]
    at, acc, left = start[order], out[order], size[order]
    for step in range(int(left[0]) if len(left) else 0):
        live = np.searchsorted(-left, -step, "left")  # slices of more than ``step`` bytes come first
        acc[:live] = (acc[:live] >> 8) ^ CRC[(acc[:live] ^ data[at[:live] + step]) & 0xFF]
    out[order] = acc ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > IN_STEP):
        out[i] = zlib.crc32(data[start[i] : end[i]])
    return out


def feature_buckets(texts: pa.Array, max_run: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each feature, its bucket, words of each document) for a block of texts."""
    off, raw = string_buffers(texts)
    data = LOWER[raw]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IN_WORD[data]
    cut_here = np.zeros(len(data) + 1, bool)
    cut_here[off] = True  # a word ends where its text ends
    begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut_here[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut_here[1:])) + 1
    doc = np.searchsorted(off, begin, "right") - 1
    words = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    owner, value = [doc], [crc32_slices(data, begin, end)]
    if max_run > 1 and len(begin):
        # the same words with exactly one space between them: every run is one slice of this
        size = end - begin
        to = np.cumsum(size + 1) - (size + 1)
        joined = np.full(int((size + 1).sum()), 32, np.uint8)
        joined[np.repeat(to - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = data[IN_WORD[data]]
        for run in range(2, max_run + 1):
            first = np.flatnonzero(doc[: len(doc) - run + 1] == doc[run - 1 :])
            last = first + run - 1
            owner.append(doc[first])
            value.append(crc32_slices(joined, to[first], to[last] + size[last]))
    return np.concatenate(owner), np.concatenate(value).astype(np.int64) % buckets, words


def bucket_counts(df: DataFrame, text_col: str = "text", max_run: int = MAX_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of features in each bucket over all rows; at most ``buckets`` rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in blocks(batch, "text", BLOCK):
                total += np.bincount(feature_buckets(text_array(part.column("text")), max_run, buckets)[1], minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["bucket", "n"])

    found = df.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed target share over the smoothed corpus share, by bucket."""
    m, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((y + 1) * (s + m)) / float((x + 1) * (t + m)))) for x, y in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(df: DataFrame, gain: np.ndarray, text_col: str = "text", max_run: int = MAX_RUN) -> DataFrame:
    """``df`` with n_words, n_features and weight: the floored mean of the gains of its features (none: 0)."""

    def start():
        def work(column: pa.Array) -> list[pa.Array]:
            owner, bucket, words = feature_buckets(text_array(column), max_run, len(gain))
            n = np.bincount(owner, minlength=len(column)).astype(np.int64)
            total = np.zeros(len(column), np.int64)
            np.add.at(total, owner, gain[bucket])
            return [pa.array(words), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))]

        return work

    return append_columns(df, start, [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")], text_col, BLOCK)


def noise(id_col: Column, seed: str = SEED) -> Column:
    """floor(1000 x a Gumbel variate) from the first 32 bits of sha256("seed:id")."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def rank_top(scored: DataFrame, k: int, eligible: str, id_col: str = "doc_id") -> DataFrame:
    """``scored`` (a column ``score``, kept at rest) with ``rank``: 1 to k by score down, then id, for rows ``eligible``; null for all others.

    Scores are integers, so their histogram is small beside the rows. ``mark`` numbers the
    rows as they lie; rows equal in score and id are numbered within the partition they
    lie in, so no value of either gathers in one task.
    """
    pool = scored.where(F.col(eligible))
    hist = pool.groupBy("score").agg(F.count("*").alias("n"))
    # suffix sums in two steps: over spans of 4,096 scores, then within each span
    spans = hist.groupBy(F.shiftright("score", 12).alias("span")).agg(F.sum("n").alias("n"))
    above = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("span", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("base"))
    within = Window.partitionBy("span").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = hist.withColumn("span", F.shiftright("score", 12)).join(spans, "span").select("score", (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("before"))
    ranks = cut(ranks.where(F.col("before") < k))  # the scores that survive
    low = ranks.agg(F.min("score")).first()[0]
    plain = [F.col(f"`{c}`") for c in scored.columns if c != "mark"]
    if low is None:
        return scored.select(*plain, F.lit(None).cast("long").alias("rank"))
    drawn = F.col(eligible) & (F.col("score") >= low)
    top = scored.where(drawn).withColumn("part", F.shiftright("mark", 33))
    key = ["score", id_col, "part"]
    cells = top.groupBy(*key).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("score").orderBy(F.asc_nulls_last(id_col), "part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("skip", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(ranks, "score")
    cells = cells.select(F.col("score").alias("s"), F.col(id_col).alias("i"), F.col("part").alias("p"), (F.col("before") + F.col("skip")).alias("before"))
    placed = top.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("mark")))
    placed = placed.join(cells, (F.col("score") == F.col("s")) & F.col(id_col).eqNullSafe(F.col("i")) & (F.col("part") == F.col("p")))
    rank = F.col("before") + F.col("nth")
    placed = placed.select(*plain, F.when(rank <= k, rank).cast("long").alias("rank"))
    return placed.unionByName(scored.where(~drawn).select(*plain, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, max_run: int = MAX_RUN, buckets: int = BUCKETS, seed: str = SEED, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without texts, with n_words, n_features, weight, score and rank (null: not drawn).

    ``percent`` (a whole number) of the documents with ``min_words`` or more are drawn.
    ``docs`` and ``target`` have a column ``text``.
    """
    made = {"n_words", "n_features", "weight", "score", "rank", "text"}
    names = [c for c in docs.columns if c.lower() not in made]
    gain = gains(bucket_counts(docs, "text", max_run, buckets), bucket_counts(target, "text", max_run, buckets))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("kept"), F.col(f"`{id_col}`").alias("id"), "text", F.monotonically_increasing_id().alias("mark"))
    scored = weigh(rows, gain, "text", max_run).drop("text")
    scored = cut(scored.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("in_pool", F.col("n_words") >= min_words))
    k = scored.where("in_pool").count() * percent // 100
    ranked = rank_top(scored, k, "in_pool", "id")
    return ranked.select(*[F.col(f"kept.`{c}`") for c in names], "n_words", "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample(docs.select("doc_id", "text"), target).select("doc_id", "n_features", "weight", "score", "rank")
