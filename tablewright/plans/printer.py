"""Prints relations onto pages as positioned words, so that readings can be held against their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GLYPH, HEIGHT, PITCH, LEFT, TOP = 10.0, 20.0, 30.0, 60.0, 100.0


def decimal_text(value: Column | str) -> Column:
    """Two decimals, the same in every engine."""
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(18,2)").cast("string")


def number_pages(rows: DataFrame, doc: Column, order: list[str], lines: int) -> DataFrame:
    """``rows`` with doc, page (from 1) and line (from 0 on its page)."""
    nth = F.row_number().over(W.partitionBy("doc").orderBy(*order)) - 1
    numbered = rows.withColumn("doc", doc).withColumn("_n", nth)
    return numbered.withColumn("page", (F.floor(F.col("_n") / lines) + 1).cast("int")).withColumn("line", (F.col("_n") % lines).cast("int")).drop("_n")


def print_fields(lines: DataFrame, xs: list[float]) -> DataFrame:
    """Words of (doc, page, y, cells array<string>): cell i starts at xs[i]; blanks part words.

    Columns: doc, page, word_id, text, x, y, width, height, confidence.
    """
    fields = lines.select("doc", "page", "y", F.posexplode("cells").alias("col", "cell")).where(F.trim("cell") != "")
    left = F.element_at(F.array(*map(F.lit, xs)), F.col("col") + 1)
    words = fields.select("doc", "page", "y", "col", left.alias("left"), F.col("cell"), F.posexplode(F.split("cell", " ")).alias("nth", "text"))
    before = F.when(F.col("nth") > 0, F.length(F.array_join(F.slice(F.split("cell", " "), 1, F.col("nth")), " ")) + 1).otherwise(0)
    return words.where("text <> ''").select(
        "doc", "page", F.xxhash64("doc", "page", "y", "col", "nth").alias("word_id"), "text", (F.col("left") + before * GLYPH).alias("x"), "y",
        (F.length("text") * GLYPH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit(1.0).alias("confidence"),
    )


def print_table(rows: DataFrame, titles: list[str], xs: list[float], titled: Column) -> DataFrame:
    """Words of rows (doc, page, line, cells) under their titles; ``titled`` says which pages print them."""
    first = F.row_number().over(W.partitionBy("doc", "page").orderBy("line")) == 1  # carries its page's titles
    own = F.struct((F.lit(TOP + PITCH) + F.col("line") * PITCH).alias("y"), "cells")
    head = F.struct(F.lit(TOP).alias("y"), F.array(*map(F.lit, titles)).alias("cells"))
    lines = F.when(F.col("_first") & titled, F.array(head, own)).otherwise(F.array(own))
    return print_fields(rows.withColumn("_first", first).select("doc", "page", F.inline(lines)), xs)


def print_lines(lines: DataFrame) -> DataFrame:
    """Words of (doc, page, line, x, text), one text a line."""
    return print_fields(lines.select("doc", "page", (F.lit(TOP) + F.col("line") * PITCH).alias("y"), F.array("text").alias("cells")), [LEFT])
