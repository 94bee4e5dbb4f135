"""What the operators of this subpackage share: Arrow mapping, splits, checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one numpy pass holds; keeps a Python worker's memory flat.
BLOCK_BYTES = 2 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of the cluster; a folder of our own only where all run on one machine and none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` behind a reliable checkpoint, so lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, group_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``df`` from a compressed table in the shared folder, computed once; few wide rows a row group."""
    return table_at(df, new_folder(df.sparkSession), group_bytes)


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def table_at(df: DataFrame, path: str, group_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``df`` from a compressed table at ``path``; small files are read several a task, unlike a checkpoint's."""
    df.write.option("compression", "zstd").option("parquet.block.size", group_bytes).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more, wherever it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows that no model may learn from: crc32 of the id's text mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_array(column: pa.Array) -> pa.Array:
    """The column as large_string without nulls (null counts as empty)."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def string_buffers(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1, from 0) and bytes of a large_string array, without a copy."""
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return off - off[0], data


def blocks(batch: pa.RecordBatch, text_col: str, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``block_bytes`` of text each, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(size, dtype=np.int64) - size) // block_bytes
    edges = np.flatnonzero(np.diff(group, prepend=-1))
    for a, b in zip(edges, [*edges[1:], batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))


def append_columns(
    df: DataFrame,
    start: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    fields: list[T.StructField],
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``df`` with columns computed from its texts, block by block, without a shuffle.

    ``start`` runs once a task and returns the function from a text array to the new
    columns. Columns of ``df`` that have a new column's name are replaced.
    """
    new = {f.name.lower() for f in fields}
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new])
    schema = T.StructType(base.schema.fields + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for part in blocks(batch, text_col, block_bytes):
                made = work(part.column(text_col))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [f.name for f in schema.fields])

    return base.mapInArrow(run, schema)


def spans_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
