"""What left-out lines are, once the whole document is known, and the log of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.functions.arrays import once

# Reasons in the log's order, their wording, and whether a person should look.
REASONS = (
    ("unplaced", "Not placed in a column", True),
    ("page-error", "Page produced no rows", True),
    ("annotation", "Printed apart from the items", False),
    ("page-field", "Printed on more than one page", False),
    ("legend", "A key to the document's own marks", False),
    ("margin", "Printed outside the table", False),
    ("note", "Note cut from an item", False),
    ("summary", "Total or subtotal", False),
    ("repeated-header", "Column titles printed again", False),
    ("furniture", "Page furniture", False),
)


def reasons(spark) -> DataFrame:
    """(reason, what, check, ord): ten rows."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(REASONS)], "reason string, what string, `check` boolean, ord int")


def refine(skipped: DataFrame, lefts: DataFrame) -> DataFrame:
    """Skipped lines (doc, page, reason, text, x, ...) with the reason that the whole document gives.

    Of the unplaced: repeated on two pages or more, then left of the page's items
    (``lefts``: doc, page, body_left), totals, legends, and lines at or right of the
    smallest indent that two unplaced lines of the document share.
    """
    was = F.col("reason") == "unplaced"
    open_ = once(skipped, norm=F.upper(T.squeeze(F.col("text")))).withColumn("_page", F.when(was, F.col("page")))
    same = W.partitionBy("doc", "norm")
    again = was & F.coalesce(F.min("_page").over(same) < F.max("_page").over(same), F.lit(False))
    marked = open_.withColumn("again", again).join(lefts, ["doc", "page"], "left")
    first = (
        F.when(~was, F.col("reason")).when(F.col("again"), "page-field").when(F.col("x") < F.col("body_left"), "margin")
        .when(T.is_document_total(F.col("norm")), "summary").when(T.is_legend(F.col("norm")), "legend").otherwise("unplaced")
    )
    settled = once(marked, _now=first)
    apart = was & (F.col("_now") == "unplaced") & (F.col("x") > F.col("body_left"))
    indented = settled.withColumn("_at", F.when(apart, F.floor("x")))
    shared = F.when(F.count("_at").over(W.partitionBy("doc", "_at")) >= 2, F.col("_at"))
    out = indented.withColumn("_shared", shared).withColumn("indent", F.min("_shared").over(W.partitionBy("doc")))
    found = F.when((F.col("_now") == "unplaced") & (F.col("x") >= F.col("indent")), "annotation").otherwise(F.col("_now"))
    return out.withColumn("reason", found).select(*skipped.columns)


def log_groups(skipped: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """(doc, reason, what, check, text, pages, page_range, times, confidence): one row a printed line and reason.

    Failed pages (doc, page, message) join as page-error. Reasons without wording are left out.
    """
    rows = skipped.select("doc", "page", "reason", "text", "confidence")
    if failures is not None:
        rows = rows.unionByName(failures.select("doc", "page", F.lit("page-error").alias("reason"), F.col("message").alias("text"), F.lit(None).cast("double").alias("confidence")))
    named = rows.join(F.broadcast(reasons(skipped.sparkSession)), "reason")
    groups = named.groupBy("doc", "reason", "what", "check", "ord", "text").agg(F.sort_array(F.collect_set("page")).alias("pages"), F.count("*").alias("times"), F.min("confidence").alias("confidence"))
    return groups.select("doc", "reason", "what", "check", "ord", "text", "pages", T.page_range(F.col("pages")).alias("page_range"), "times", "confidence")


def log_csv(groups: DataFrame) -> DataFrame:
    """(doc, csv): the log as a spreadsheet."""
    field = lambda c: T.csv_field(F.coalesce(c, F.lit("")))
    shown = F.when(F.col("confidence").isNotNull(), F.col("confidence").cast("decimal(5,2)").cast("string"))
    cells = [F.when(F.col("check"), "yes").otherwise("no"), F.col("what"), F.col("page_range"), F.col("times").cast("string"), F.col("text"), shown]
    lines = groups.select("doc", "ord", "pages", "text", F.array_join(F.array(*map(field, cells)), ",").alias("line"))
    joined = F.transform(F.sort_array(F.collect_list(F.struct("ord", "pages", "text", "line"))), lambda s: s["line"])
    return lines.groupBy("doc").agg(F.concat(F.lit("Check,Kind,Pages,Times,Printed text,Confidence\r\n"), F.array_join(joined, "\r\n")).alias("csv"))


def needs_checking(groups: DataFrame) -> DataFrame:
    """(doc, lines, times): what a person should look at."""
    return groups.where("`check`").groupBy("doc").agg(F.count("*").alias("lines"), F.sum("times").alias("times"))
