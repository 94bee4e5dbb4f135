"""Quality classifier: a byte-level convolutional network in numpy.

A text is covered by overlapping chunks of ``WIDTH`` bytes, one every ``STRIDE``
bytes, from its first byte to its last. Learned byte embeddings and learned filters
give each chunk one value a filter; a chunk also knows whether its first eight bytes
appeared up to ``LAGS`` bytes earlier (repetition). The largest value of each filter
over the whole text is kept, and a logistic layer combines them into one probability.

Learning: Adam on the logistic loss; a gradient reaches the chunks that won the
maximum. It reads about ``per_class`` documents a label, picked from the labels by a
hash of the id, and of a text longer than ``EXCERPT`` characters ``WINDOWS`` equal windows from its first to its
last; one task, whose size this bounds, does it. The picked ids are broadcast, so that no
text but theirs moves; of an id whose texts differ the one with the smallest hash is read. Half of each class would tilt the prior, so the bias is set back to the
class shares of all labelled rows. Scoring reads whole texts of any length.

Null texts count as empty; an empty text is one chunk of padding and has a score.
Rows with null labels or ids teach nothing; null ids never count as held out; without
both classes every score is the share of label 1 (0.5 without labels). Repeated rows
are scored one by one, an empty table gives an empty table. Columns of the input that
have a result column's name are replaced.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, held_out, spans_of, string_buffers, table, text_array

WIDTH, STRIDE, LAGS = 12, 4, 32
EMBEDDING, FILTERS = 6, 24
PER_CLASS = 2500
EXCERPT, WINDOWS = 6000, 6
EPOCHS, BATCH, RATE = 10, 32, 0.004
SEED = 13
#: Zeros before each text, so that no chunk looks back into another text.
GAP = LAGS + 8


def lay_out(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with gaps and padding in one byte array; first chunk and chunk count of each text."""
    n = np.diff(off)
    chunks = np.maximum(1, -(-(n - WIDTH) // STRIDE) + 1)
    room = GAP + WIDTH + STRIDE * (chunks - 1)
    begin = np.cumsum(room) - room + GAP
    out = np.zeros(int(room.sum()) + 8, np.uint8)
    out[spans_of(begin, n)] = data
    return out, begin // STRIDE, chunks


def repeats(laid: np.ndarray, count: int) -> np.ndarray:
    """For each chunk start whether its eight bytes also start up to LAGS bytes earlier."""
    at = GAP // STRIDE
    grams = np.ndarray((count - at,), "<u8", laid, GAP, (STRIDE,))
    seen = np.zeros(count - at, bool)
    for lag in range(2, LAGS + 1):
        seen |= grams == np.ndarray((count - at,), "<u8", laid, GAP - lag, (STRIDE,))
    seen &= grams != 0
    return np.concatenate([np.zeros(at, bool), seen])


@dataclass
class ByteNetwork:
    embedding: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    weights: np.ndarray
    bias: float

    @classmethod
    def fresh(cls, seed: int = SEED) -> ByteNetwork:
        rnd = np.random.default_rng(seed)
        size = WIDTH * EMBEDDING + 1
        return cls(
            rnd.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32), rnd.normal(0, 1 / math.sqrt(size), (size, FILTERS)).astype(np.float32),
            np.zeros(FILTERS, np.float32), rnd.normal(0, 0.3, FILTERS).astype(np.float32), 0.0,
        )

    def chunks(self, laid: np.ndarray, count: int) -> np.ndarray:
        """Features of every chunk start, gaps included."""
        x = np.empty((count, WIDTH * EMBEDDING + 1), np.float32)
        seen = np.lib.stride_tricks.sliding_window_view(self.embedding[laid].reshape(-1), WIDTH * EMBEDDING)[:: STRIDE * EMBEDDING]
        x[:, :-1] = seen[:count]
        x[:, -1] = repeats(laid, count)
        return x

    def pooled(self, off: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Each text's largest value of each filter."""
        laid, first, n = lay_out(off, data)
        count = int(first[-1] + n[-1])
        values = np.maximum(self.chunks(laid, count) @ self.filters + self.filter_bias, 0)
        bounds = np.column_stack([first, first + n]).ravel()
        return np.maximum.reduceat(values, bounds[:-1], axis=0)[::2]

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        off, data = string_buffers(texts)
        exact = 1 / (1 + np.exp(-(self.pooled(off, data).astype(np.float64) @ self.weights + self.bias)))
        return np.round(exact, 6)  # single precision beyond that depends on what else is in the block


def train(texts: list[bytes], labels: np.ndarray, prior: float) -> ByteNetwork:
    """Fit on a bounded sample; ``prior`` is the share of label 1 among all labelled rows."""
    net, rnd = ByteNetwork.fresh(), np.random.default_rng(SEED)
    names = ["embedding", "filters", "filter_bias", "weights"]
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    step, moments, cols = 0, [0.0, 0.0], np.arange(WIDTH)
    for epoch in range(EPOCHS):
        rate = RATE * 0.5 * (1 + math.cos(math.pi * epoch / EPOCHS))
        order = rnd.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            off = np.concatenate([[0], np.cumsum([len(texts[r]) for r in rows])]).astype(np.int64)
            laid, begin, n = lay_out(off, np.frombuffer(b"".join(texts[r] for r in rows), np.uint8))
            count = int(begin[-1] + n[-1])
            x = net.chunks(laid, count)
            z = x @ net.filters + net.filter_bias
            won = np.array([a + z[a : a + k].argmax(0) for a, k in zip(begin, n, strict=True)])  # rows x filters
            top = np.take_along_axis(z, won, 0)
            h = np.maximum(top, 0)
            error = (1 / (1 + np.exp(-(h @ net.weights + net.bias))) - labels[rows]).astype(np.float32) / len(rows)
            back = error[:, None] * net.weights * (top > 0)
            seen = x[won]  # rows x filters x features
            d_x = back[:, :, None] * net.filters.T[None]
            grads = {
                "filters": np.einsum("rf,rfx->xf", back, seen), "filter_bias": back.sum(0), "weights": h.T @ error + 1e-4 * net.weights,
                "embedding": np.zeros_like(net.embedding),
            }
            used = laid[won[:, :, None] * STRIDE + cols]
            np.add.at(grads["embedding"], used, d_x[:, :, :-1].reshape(*won.shape, WIDTH, EMBEDDING))
            step += 1
            scale = rate * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                getattr(net, k)[...] -= scale * first[k] / (np.sqrt(second[k]) + 1e-8)
            g = float(error.sum())
            moments = [moments[0] + 0.1 * (g - moments[0]), moments[1] + 0.001 * (g * g - moments[1])]
            net.bias -= scale * moments[0] / (math.sqrt(moments[1]) + 1e-8)
    share = labels.mean()
    net.bias += math.log(prior / (1 - prior)) - math.log(share / (1 - share))
    return net


def learn_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> ByteNetwork | float:
    """The network, or a constant score where a class is missing."""
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").distinct()
    sizes = {r.y: r.n for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        return sizes.get(1, 0) / total if total else 0.5
    share = [int(min(1.0, per_class / sizes[y]) * (1 << 30)) for y in (0, 1)]
    picked = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < F.when(F.col("y") == 0, share[0]).otherwise(share[1]))
    prior = min(max(sizes[1] / total, 1e-3), 1 - 1e-3)
    text = F.coalesce(F.col(text_col), F.lit(""))
    width = EXCERPT // WINDOWS
    windows = [F.substr(text, (1 + F.floor((F.length(text) - width) * i / (WINDOWS - 1))).cast("int"), F.lit(width)) for i in range(WINDOWS)]
    read = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.when(F.length(text) > EXCERPT, F.concat(*windows)).otherwise(text).alias("excerpt"))
    rows = read.join(F.broadcast(picked), "doc_id")  # about 2 x per_class ids
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text"), "excerpt"))["excerpt"].alias("text"))

    def fit(part: pa.Table) -> pa.Table:
        part = part.sort_by([("doc_id", "ascending"), ("y", "ascending"), ("text", "ascending")])
        y = part["y"].to_numpy().astype(np.float32)
        made = train([t.encode() for t in part["text"].to_pylist()], y, prior) if 0 < y.mean() < 1 else prior
        return pa.table({"model": pa.array([pickle.dumps(made)], pa.binary())})

    got = rows.groupBy(F.lit(0).alias("one")).applyInArrow(fit, "model binary").collect()
    return pickle.loads(got[0].model) if got else prior


def score_quality(df: DataFrame, model: ByteNetwork | float, text_col: str = "text") -> DataFrame:
    """``df`` with score and predicted."""

    def start():
        def work(column: pa.Array) -> list[pa.Array]:
            score = np.full(len(column), float(model)) if isinstance(model, float) else model.scores(text_array(column))
            return [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))]

        return work

    return append_columns(df, start, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], text_col, 1 << 18)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn_quality(docs.where(~held_out()), labels.where(~held_out()))
    return score_quality(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
