"""Review of readings: what needs a look, edits and acceptances over the rows, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

THRESHOLD = 0.55


def row_status(rows: DataFrame, accepted: DataFrame, issues: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc, page, row, kind, cells, confidence, label) with flagged, incomplete, solved and review.

    accepted: (doc, page, row); issues: (doc, page, code, rows). A table row is
    incomplete with fewer than two filled cells, any other kind with a blank one; labels never are.
    """
    marks = issues.select("doc", "page", F.explode("rows").alias("row"), (F.col("code") == "inventory-solved").alias("s")).groupBy("doc", "page", "row").agg(F.max("s").alias("solved"), F.max(~F.col("s")).alias("flagged"))
    filled = F.size(F.filter("cells", lambda c: F.trim(c) != ""))
    incomplete = ~F.col("label") & F.when(F.col("kind") == "table", filled < 2).otherwise(filled < F.size("cells"))
    ok = accepted.select("doc", "page", "row").distinct().withColumn("accepted", F.lit(True))
    out = rows.join(marks, ["doc", "page", "row"], "left").join(ok, ["doc", "page", "row"], "left").fillna(False, ["solved", "flagged", "accepted"]).withColumn("incomplete", incomplete)
    return out.withColumn("review", (F.col("flagged") | (F.col("confidence") < threshold) | F.col("incomplete")) & ~F.col("accepted"))


def valid_counts(status: DataFrame) -> DataFrame:
    """(doc, total, valid)"""
    return status.groupBy("doc").agg(F.count("*").alias("total"), F.count_if(~F.col("review")).alias("valid"))


def grid_stats(status: DataFrame, edited: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(scope, total, flagged, edited, valid): counts over the rows of ``row_status``; edited: (doc, page, row)."""
    marks = edited.select("doc", "page", "row").distinct().withColumn("_e", F.lit(True))
    keys = scope or ["doc"]
    return status.join(marks, ["doc", "page", "row"], "left").groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if("review").alias("flagged"), F.count_if(F.col("_e")).alias("edited"), F.count_if(~F.col("review")).alias("valid")
    )


def matched_pages(found: DataFrame) -> DataFrame:
    """(doc, pages): on how many pages a search found rows."""
    return found.groupBy("doc").agg(F.count_distinct("page").alias("pages"))


def tables_on_page(tables: DataFrame) -> DataFrame:
    """Extra tables (doc, page, pos, title, headers, rows) of each page that hold a row."""
    return tables.where(F.size("rows") > 0)


def apply_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows with the last edit (doc, page, row, cell, value, seq) of each cell, and ``edited``."""
    last = edits.groupBy("doc", "page", "row", "cell").agg(F.max_by("value", "seq").alias("value"))
    maps = last.groupBy("doc", "page", "row").agg(F.map_from_entries(F.collect_list(F.struct("cell", "value"))).alias("_e"))
    out = rows.join(maps, ["doc", "page", "row"], "left").withColumn("edited", F.col("_e").isNotNull())
    return out.withColumn("cells", F.when(F.col("edited"), F.transform("cells", lambda c, i: F.coalesce(F.try_element_at("_e", i), c))).otherwise(F.col("cells"))).drop("_e")


def search(rows: DataFrame, query: str) -> DataFrame:
    """Rows with ``query`` in a cell, case aside."""
    return rows.where(F.exists("cells", lambda c: F.contains(F.lower(c), F.lit(query.lower()))))


def first_rows(rows: DataFrame, n: int = 12) -> DataFrame:
    """The first ``n`` rows of each document, as a viewer shows them."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("doc").orderBy("page", "row"))).where(F.col("_n") <= n).drop("_n")


def moved_lines(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of two readings of the same columns that are not in both, with ``side`` - or +; repeats count."""
    gone, new = before.exceptAll(after), after.exceptAll(before)
    return gone.withColumn("side", F.lit("-")).unionByName(new.withColumn("side", F.lit("+")))


def overlay(words: DataFrame, pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Words as percentages of their page's width and height, and whether they were read unsurely."""
    size = pages.select("doc", "page", F.col("width").alias("_w"), F.col("height").alias("_h"))
    at = words.join(size, ["doc", "page"])
    share = lambda c, of: (100 * F.col(c) / F.col(of)).alias(c)
    return at.select("doc", "page", "word_id", "text", share("x", "_w"), share("y", "_h"), share("width", "_w"), share("height", "_h"), (F.col("confidence") < threshold).alias("low"))
