"""Token counts: each distinct pre-token is counted once and joined to the documents' frequencies.

1. Tasks tally the pre-tokens of their texts by blocks of ``BLOCK`` bytes. A block numbers
   its distinct pre-tokens; its documents' frequencies are held as those numbers. The
   blocks are written once, so no later attempt can number them differently.
2. A pre-token travels once a block, whatever its frequency or length, to a join with the
   distinct pre-tokens, of which the library tells once how many pieces each has. So a key
   of the join has a row a block at most.
3. The pieces come back as one array a block, in the block's numbers, and each document's
   frequencies are summed against it.

No ids of a document are ever made. Null texts count as empty (0 tokens), empty texts
have 0 tokens, repeated rows count each by itself, texts of any length are tallied
whole (a long text is a block of its own), an empty table gives an empty table. Columns of
the input that have a result column's name are replaced; the texts themselves are not
part of the result.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK_BYTES, append_columns, blocks, table, text_array, written
from .pretokens import Pretokens, byte_letters, default_path, load

#: Bytes of documents whose pre-tokens are numbered together: fewer blocks send fewer words.
BLOCK = 32 << 20


def packed(sizes: list[int], slots: list[int], times: list[int]) -> bytes:
    """Frequencies of a block: for each document how many words, their numbers in order as steps, how often each."""
    document, slot = np.repeat(np.arange(len(sizes)), sizes), np.array(slots, np.int64)
    order = np.lexsort((slot, document))
    flat = np.concatenate([sizes, np.diff(slot[order], prepend=0), np.array(times, np.int64)[order]]).astype("<i4")
    return zlib.compress(flat.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, slots, times) of ``packed``."""
    flat = np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<i4").ravel().astype(np.int64)
    steps, times = np.split(flat[documents:], 2)
    return flat[:documents], np.cumsum(steps), times


def number_blocks(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(kept, n_bytes, words, tallies), one row a block: its documents without text, its distinct pre-tokens, its frequencies."""
    kept = rows.schema["kept"].dataType
    made = T.StructType([
        T.StructField("kept", T.ArrayType(kept)),
        T.StructField("n_bytes", T.ArrayType(T.LongType())),
        T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("tallies", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Pretokens(load(vocabulary or default_path("byte_bpe_50k.json"))[1])

        def start() -> None:
            nonlocal number, parts, lengths, sizes, slots, times, held
            number = defaultdict()
            number.default_factory = number.__len__
            parts, lengths, sizes, slots, times, held = [], [], [], [], [], 0

        def block() -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (pa.concat_arrays(parts), pa.concat_arrays(lengths), pa.array(list(number), pa.string()))]
            return pa.RecordBatch.from_arrays([*lists, pa.array([packed(sizes, slots, times)], pa.binary())], made.names)

        number = parts = lengths = sizes = slots = times = held = None
        start()
        for batch in batches:
            for part in blocks(batch, "text", BLOCK_BYTES):
                texts = text_array(part.column("text"))
                for text in texts.to_pylist():
                    tally = Counter(map(number.__getitem__, split(text)))
                    sizes.append(len(tally))
                    slots += tally
                    times += tally.values()
                parts.append(part.column("kept"))
                lengths.append(pc.binary_length(texts).cast(pa.int64()))
                held += part.nbytes
                if held >= BLOCK:
                    yield block()
                    start()
        if parts:
            yield block()

    return rows.select("kept", "text").mapInArrow(run, made)


def count_pieces(words: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``words`` (word and others) with ``pieces``, the length that the library's merges leave."""

    def start():
        tokenizer, added = load(vocabulary or default_path("byte_bpe_50k.json"))
        letters = {b: c for b, c in byte_letters().items() if chr(b) != c}
        merge = tokenizer.model.tokenize

        def work(column: pa.Array) -> list[pa.Array]:
            return [pa.array([1 if w in added else len(merge(w.encode().decode("latin-1").translate(letters))) for w in column.to_pylist()], pa.int64())]

        return work

    return append_columns(words, start, [T.StructField("pieces", T.LongType())], "word")


def sum_blocks(held: DataFrame) -> DataFrame:
    """(kept, n_bytes, n_tokens), one row a document, of blocks with ``pieces``: number and pieces of each word in one long."""
    made = T.StructType([T.StructField("kept", held.schema["kept"].dataType.elementType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                kept, n_bytes, pieces = (batch.column(c).slice(i, 1).flatten() for c in ("kept", "n_bytes", "pieces"))
                sizes, slots, times = unpacked(batch.column("tallies")[i].as_py(), len(kept))
                came = pieces.to_numpy(zero_copy_only=False).astype(np.int64)
                of_slot = np.zeros(len(came), np.int64)
                of_slot[came >> 32] = came & 0xFFFFFFFF
                sums = np.concatenate([[0], np.cumsum(times * of_slot[slots])])
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([kept, n_bytes, pa.array(sums[ends] - sums[ends - sizes], pa.int64())], made.names)

    return held.mapInArrow(run, made)


def count_tokens(df: DataFrame, vocabulary: str | None = None, limit: int = 512, text_col: str = "text") -> DataFrame:
    """``df`` without its texts, with n_bytes, n_tokens and over_limit (n_tokens > ``limit``)."""
    taken = {"n_bytes", "n_tokens", "over_limit", text_col.lower()}
    names = [c for c in df.columns if c.lower() not in taken]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names] or [F.lit(0)]).alias("kept"), F.col(f"`{text_col}`").alias("text"))
    held = written(number_blocks(rows, vocabulary).withColumn("block", F.monotonically_increasing_id()))
    # Both sides of the join stand on one shuffle: the filters and the least places, which say nothing new, keep their plans alike.
    sent = held.select("block", F.posexplode("words").alias("slot", "word")).where("block is not null and word is not null").repartition("word")
    distinct = sent.groupBy("word").agg(F.min("block").alias("block"), F.min("slot").alias("slot"))
    counted = count_pieces(distinct, vocabulary).select("word", "pieces")
    place = F.shiftleft(F.col("slot").cast("long"), 32).bitwiseOR(F.col("pieces"))
    back = sent.join(counted.hint("merge"), "word").groupBy("block").agg(F.collect_list(place).alias("pieces"))
    pieces = F.coalesce("pieces", F.array().cast("array<long>")).alias("pieces")
    sums = sum_blocks(held.drop("words").join(back, "block", "left").select("kept", "n_bytes", "tallies", pieces))
    n = F.col("n_tokens")
    return sums.select(*[F.col(f"kept.`{c}`") for c in names], "n_bytes", n, (n > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
