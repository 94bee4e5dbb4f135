"""Language identification with bit-sliced Bloom filters of n-grams.

One Bloom filter a language, stored side by side: slot i holds one bit of every
language's filter (in as many 64-bit words as the languages need), so a single probe
per hash returns the set of all languages that may contain an n-gram, as a bitmask. A document's n-grams give one count a language
(how many of its n-grams have that language's bit); the counts are corrected for the
filters' false positives, and the largest decides.

An n-gram is ``N`` bytes of the lower-cased UTF-8 text in which every ASCII byte that
is no letter became a space. A language contains it if the n-gram is no rarer there
than ``SHARE`` of its rate in the language that uses it most, and makes up at least
``MIN_RATE`` of the language's sample.

Learning uses a bounded sample (about ``max_docs`` documents a language, picked by a
hash of the id) of every language; the model grows with the number of languages, not of
documents. Prediction reads whole texts.

``coverage`` is the share of a text's n-grams that its language knows (corrected in the
same way): low for junk and for languages that were never learned.

Null texts and texts without a letter give ``und``, score 0 and coverage 0. Texts that no
filter knows get the most frequent language with score 0. Very long texts are read to
their end. Ties go to the first language in
alphabetical order. Repeated rows are judged one by one, null ids never count as held
out, an empty table gives an empty table, and without training rows everything is
``und``. Columns of the input that have a result column's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, blocks, held_out, string_buffers, table, text_array

N = 4
SHARE = 0.25
MIN_RATE = 1e-5
SLOTS = 1 << 18
#: Odd multipliers of the two hash functions.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MAX_DOCS = 2000
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128][[not chr(i).isalpha() for i in range(128)]] = ord(" ")


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of the texts, and offsets of each text's own (n + 1)."""
    blank, blanks, glue = (pa.scalar(x, pa.large_string()) for x in (" ", "  ", ""))
    off, data = string_buffers(pc.binary_join_element_wise(blank, pc.utf8_lower(texts), blanks, glue))
    if len(data) < N:
        return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
    folded = _FOLD[data]
    codes = np.ndarray((len(folded) - N + 1,), "<u4", folded, strides=(1,))
    counts = np.maximum(np.diff(off) - N + 1, 0)
    keep = np.ones(len(codes), bool)
    for back in range(1, N):  # windows that reach into the next text
        ends = off[1:-1] - back
        keep[ends[ends >= 0]] = False
    return codes[keep], np.concatenate([[0], np.cumsum(counts)])


def _slots(codes: np.ndarray) -> Iterator[np.ndarray]:
    shift = np.uint64(64 - SLOTS.bit_length() + 1)
    wide = codes.astype(np.uint64)
    for m in MULTIPLIERS:
        yield ((wide * np.uint64(m)) >> shift).astype(np.int64)


@dataclass
class LanguageModel:
    """Filters of all languages: ``masks[i // word, slot]`` has bit i % word if language i's filter has that slot."""

    languages: list[str]
    masks: np.ndarray
    fallback: str

    def bit(self, masks: np.ndarray, i: int) -> np.ndarray:
        """Language i's bit of masks (words x n)."""
        return (masks[i // self.word] >> masks.dtype.type(i % self.word)) & masks.dtype.type(1)

    @property
    def word(self) -> int:
        return 8 * self.masks.dtype.itemsize

    @property
    def false_positive(self) -> np.ndarray:
        return np.array([self.bit(self.masks, i).mean() for i in range(len(self.languages))]) ** len(MULTIPLIERS)

    @classmethod
    def build(cls, members: dict[str, np.ndarray], fallback: str) -> LanguageModel:
        languages = sorted(members)
        dtype = np.dtype(next((f"u{w}" for w in (1, 2, 4) if len(languages) <= 8 * w), "u8"))
        word = 8 * dtype.itemsize
        masks = np.zeros((-(-len(languages) // word), SLOTS), dtype)
        for i, name in enumerate(languages):
            for slots in _slots(members[name]):
                masks[i // word, np.unique(slots)] |= dtype.type(1 << i % word)
        return cls(languages, masks, fallback)

    def languages_of(self, codes: np.ndarray) -> np.ndarray:
        """For each n-gram the bitmask of the languages that may contain it (words x n)."""
        first, second = _slots(codes)
        return self.masks[:, first] & self.masks[:, second]

    def decide(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and coverage of each text."""
        codes, off = ngrams(texts)
        masks = self.languages_of(codes)
        total = np.diff(off).astype(np.float64)
        counts = np.empty((len(self.languages), len(texts)))
        for i, fp in enumerate(self.false_positive):
            seen = np.concatenate([[0], np.cumsum(self.bit(masks, i), dtype=np.int64)])
            counts[i] = np.maximum((seen[off[1:]] - seen[off[:-1]] - total * fp) / max(1e-9, 1 - fp), 0)
        best, votes, most = counts.argmax(0), counts.sum(0), counts.max(0)
        score = np.where(votes > 0, most / np.maximum(votes, 1e-12), 0.0)
        letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
        names = [(self.languages[b] if v > 0 else self.fallback) if ok else UNKNOWN for b, v, ok in zip(best, votes, letters, strict=True)]
        return names, np.where(letters, score, 0.0), np.where(letters, np.minimum(most / np.maximum(total, 1), 1.0), 0.0)


def _count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks(batch, "text", 2 << 20):
            codes, off = ngrams(text_array(part.column("text")))
            of = np.repeat(part.column("which").to_numpy().astype(np.uint64), np.diff(off))
            pairs, n = np.unique((of << np.uint64(32)) | codes, return_counts=True)
            cols = (pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF), n)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["which", "code", "n"])


def learn_languages(docs: DataFrame, max_docs: int = MAX_DOCS) -> LanguageModel | None:
    """Fit on rows with text and lang; about ``max_docs`` documents a language, every language.

    What reaches the driver is bounded: a row a language, and at most 1 / MIN_RATE n-grams
    of each as numbers.
    """
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()}
    if not sizes:
        return None
    names = sorted(sizes)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    shares = docs.sparkSession.createDataFrame([(x, i, int(min(1.0, max_docs / sizes[x]) * (1 << 30))) for i, x in enumerate(names)], "lang string, which long, share long")
    picked = rows.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("which", "text")
    grams = picked.mapInArrow(_count_ngrams, "which long, code long, n long").groupBy("code", "which").agg(F.sum("n").alias("n"))
    totals = grams.groupBy("which").agg(F.sum("n").alias("total"))
    rates = grams.join(F.broadcast(totals), "which").select("which", "code", (F.col("n") / F.col("total")).alias("rate"))
    best = rates.groupBy("code").agg(F.max("rate").alias("top"), F.collect_list(F.struct("which", "rate")).alias("in"))
    kept = best.where(F.col("top") >= MIN_RATE).select("code", "top", F.explode("in").alias("x")).where((F.col("x.rate") >= SHARE * F.col("top")) & (F.col("x.rate") >= MIN_RATE))
    got = kept.select("code", F.col("x.which").alias("which")).toArrow()
    which, codes = got["which"].to_numpy(), got["code"].to_numpy().astype(np.uint32)
    members = {name: np.sort(codes[which == i]) for i, name in enumerate(names)}
    return LanguageModel.build(members, fallback=next(iter(sizes)))


def identify_languages(df: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred, score and coverage."""

    def start():
        def work(column: pa.Array) -> list[pa.Array]:
            if model is None:
                names, score, coverage = [UNKNOWN] * len(column), np.zeros(len(column)), np.zeros(len(column))
            else:
                names, score, coverage = model.decide(text_array(column))
            return [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(coverage, pa.float64())]

        return work

    return append_columns(df, start, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("coverage", T.DoubleType())], text_col, 1 << 20)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_languages(docs.where(~held_out()))
    return identify_languages(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "coverage")
