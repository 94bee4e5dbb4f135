"""Readings as streams: pages are independent, so each micro-batch is read by the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablewright.operators import tables


def word_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Words arriving as Parquet files; a page's words arrive in one file."""
    return spark.readStream.schema(schema).parquet(folder)


def stream_rows(words: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's table rows to ``out``; a replayed batch overwrites its own part."""

    def write(batch: DataFrame, nth: int) -> None:
        tables.table_rows(tables.read_lines(batch)).write.mode("overwrite").parquet(f"{out}/batch={nth}")

    return words.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, value) of an event stream, with late rows dropped by a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    counted = timed.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "n", "value")
