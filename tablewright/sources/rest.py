"""Lineage cut by reliable checkpoints in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

#: Rows that one task is dealt, of however many.
ROWS_A_TASK = 50_000


def at_rest(df: DataFrame) -> DataFrame:
    """The rows behind a checkpoint in spark.checkpoint.dir; a folder of our own only where all run on one machine and none is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in a number of partitions that grows with its ``rows``, so that a task's sorts do not.

    Left to itself Spark joins partitions by their compressed size, of which printed rows have little.
    """
    return df.repartition(rows // ROWS_A_TASK + 1, *keys)
