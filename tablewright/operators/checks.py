"""Arithmetic checks of readings, and the solver for one missing count.

Rows carry (doc, page, row, cells); issues are (doc, page, code, rows array<int>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.functions import text as T

from .geometry import PAGE

COUNTS = ("Int", "Rec", "Act", "Set")
# The lines that add up to a weekly invoice's total, the total, and the lines a section restates; letters and digits only.
PARTS = ("fwdbalance", "onlinenetdue", "instantnetdue", "nongameadjustments", "systemfee", "otherretailerincentives")
TOTAL = "totalduebywed"
RESTATED = ("onlinenetdue", "instantnetdue")


def count_columns(rows: DataFrame) -> DataFrame:
    """(doc, page, row, totals, pos, count): cells Game, Name and four counts, one row a count.

    ``totals`` marks the first row named TOTALS; later ones are no items either.
    """
    named = rows.withColumn("_t", T.is_totals(F.element_at("cells", 2)) | T.is_totals(F.element_at("cells", 1)))
    first = F.min(F.when(F.col("_t"), F.col("row"))).over(W.partitionBy(*PAGE))
    cells = named.select(*PAGE, "row", (F.col("_t") & (F.col("row") == first)).alias("totals"), F.col("_t").alias("any_totals"), F.posexplode(F.slice("cells", 3, 4)).alias("pos", "cell"))
    return cells.select(*PAGE, "row", "totals", "any_totals", "pos", T.count_number(F.col("cell")).alias("count"))


def solve_counts(counts: DataFrame) -> DataFrame:
    """The counts with ``solved``: the one unreadable count of a column whose total is stated
    gets what is missing, if that is between 0 and 999."""
    col = W.partitionBy(*PAGE, "pos")
    item = ~F.col("any_totals")
    unknown = F.sum((item & F.col("count").isNull()).cast("int")).over(col)
    missing = F.max(F.when(F.col("totals"), F.col("count"))).over(col) - F.coalesce(F.sum(F.when(item, F.col("count"))).over(col), F.lit(0))
    fill = item & F.col("count").isNull() & (F.col("_u") == 1) & F.col("_m").between(0, 999)
    out = counts.withColumn("_u", unknown).withColumn("_m", missing)
    return out.withColumn("solved", fill & F.col("_m").isNotNull()).withColumn("count", F.when(fill, F.col("_m").cast("int")).otherwise(F.col("count"))).drop("_u", "_m")


def inventory_issues(counts: DataFrame) -> DataFrame:
    """inventory-solved, inventory-unread and inventory-totals of solved counts, told in one pass over each page's columns."""
    item = ~F.col("any_totals")
    row = F.col("row").cast("int")
    sums = counts.groupBy(*PAGE, "pos").agg(
        F.coalesce(F.sum(F.when(item, F.col("count"))), F.lit(0)).alias("sum"), F.max(F.when(F.col("totals"), F.col("count"))).alias("stated"),
        F.sort_array(F.collect_set(F.when(item & F.col("count").isNull(), row))).alias("blank"), F.max(F.when(F.col("totals"), row)).alias("at"),
        F.collect_list(F.when(F.col("solved"), row)).alias("solved"), F.collect_set(F.when(F.col("count").isNull(), row)).alias("unread"),
    )
    wrong = F.when(F.col("stated") != F.col("sum"), F.when(F.size("blank") > 0, F.col("blank")).otherwise(F.array("at")))
    pages = sums.groupBy(*PAGE).agg(F.flatten(F.collect_list("solved")).alias("solved"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("unread")))).alias("unread"), F.collect_list(wrong).alias("wrong"))
    issue = lambda code, rows: F.struct(F.lit(code).alias("code"), rows.alias("rows"))
    told = F.concat(
        F.transform("solved", lambda r: issue("inventory-solved", F.array(r))), F.transform(F.filter(F.array("unread"), lambda r: F.size(r) > 0), lambda r: issue("inventory-unread", r)),
        F.transform("wrong", lambda r: issue("inventory-totals", r)),
    )
    return pages.select(*PAGE, F.inline(told))


def settlement_issues(rows: DataFrame, stated: DataFrame) -> DataFrame:
    """settlements-count where the stated number of packs differs, settlements-unread for rows with a blank."""
    n = rows.groupBy(*PAGE).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.exists("cells", lambda c: F.trim(c) == ""), F.col("row").cast("int")))).alias("blank"))
    count = n.join(stated, PAGE).where(F.col("stated") != F.col("n")).select(*PAGE, F.lit("settlements-count").alias("code"), F.array().cast("array<int>").alias("rows"))
    return count.unionByName(n.where(F.size("blank") > 0).select(*PAGE, F.lit("settlements-unread").alias("code"), F.col("blank").alias("rows")))


def invoice_issues(fields: DataFrame, parts: tuple[str, ...] = PARTS, total: str = TOTAL, restated: tuple[str, ...] = RESTATED) -> DataFrame:
    """invoice-total where all parts are read and do not add up, invoice-section-total where one of ``restated`` ends on another figure.

    fields: (doc, page, row, label, value); the first row of a label counts, a section is
    held against the last. Rows come in the order of the parts, the total's last.
    """
    keyed = fields.select(*PAGE, F.col("row").cast("int").alias("row"), T.flat(F.col("label")).alias("key"), T.cents(F.col("value")).alias("cents"))
    named = keyed.where(F.col("key").isin(*parts, total)).groupBy(*PAGE, "key").agg(F.min_by("cents", "row").alias("cents"), F.min("row").alias("row"))
    part = F.col("key") != total
    place = F.array_position(F.array(*map(F.lit, (*parts, total))), F.col("key"))
    added = named.groupBy(*PAGE).agg(
        F.sum(F.when(part, F.col("cents"))).alias("sum"), F.count(F.when(part, F.col("cents"))).alias("n"), F.max(F.when(~part, F.col("cents"))).alias("stated"),
        F.transform(F.sort_array(F.collect_list(F.struct(place.alias("place"), "row"))), lambda x: x["row"]).alias("rows"),
    )
    off = added.where((F.col("n") == len(parts)) & (F.col("stated") != F.col("sum"))).select(*PAGE, F.lit("invoice-total").alias("code"), "rows")
    twice = keyed.where(F.col("key").isin(*restated)).groupBy(*PAGE, "key").agg(F.count("*").alias("n"), F.min_by("cents", "row").alias("a"), F.max_by("cents", "row").alias("b"), F.array(F.min("row"), F.max("row")).alias("rows"))
    again = twice.where((F.col("n") > 1) & (F.col("a") != F.col("b"))).select(*PAGE, F.lit("invoice-section-total").alias("code"), "rows")
    return off.unionByName(again)


def choose_kind(inventory: Column, totals: Column, settlements: Column, invoice: Column) -> Column:
    """The kind of a page from how many rows each reader found."""
    score = inventory + F.when(totals, 2).otherwise(0)
    return (
        F.when((score >= 3) & (score >= settlements), "inventory").when((settlements >= 3) & (settlements >= invoice), "settlements")
        .when(invoice > 0, "invoice").when(settlements > 0, "settlements").otherwise("inventory")
    )
