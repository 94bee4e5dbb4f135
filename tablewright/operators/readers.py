"""Readers of pages with a fixed schema: settlements, invoices, inventories.

Each finds its anchors on the page (pack codes, amounts, game numbers) by a word
predicate and takes the words of the anchor's line around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.functions.arrays import let, once

from .geometry import PAGE, group_lines
from .words import with_lone_dates


def _joined(when: Column) -> Column:
    """The texts of the words for which ``when`` holds, left to right."""
    picked = F.sort_array(F.collect_list(F.when(when, F.struct("x", "text"))))
    return F.array_join(F.transform(picked, lambda s: s["text"]), " ")


def _numbered(rows: DataFrame, cells: list[Column]) -> DataFrame:
    row = F.row_number().over(W.partitionBy(*PAGE).orderBy("line_id")) - 1
    return rows.select(*PAGE, row.alias("row"), F.array(*cells).alias("cells"), "confidence")


def _page_right(words: DataFrame) -> DataFrame:
    return words.withColumn("page_right", F.max(F.col("x") + F.col("width")).over(W.partitionBy(*PAGE)))


def settlements(words: DataFrame) -> DataFrame:
    """(doc, page, row, cells, confidence): Game-Pack, Name, Date Settled; a lone date opens a row without a pack."""
    lines = _page_right(group_lines(words))
    text = F.col("text")
    pack = T.pack_token(text)
    left = F.col("x") < 0.4 * F.col("page_right")
    code = let(pack, lambda p: F.when(p.rlike("^[0-9]{3}-[0-9]{5,8}$"), p))
    marked = with_lone_dates(once(lines, pack=F.when(left & F.contains(text, F.lit(T.PACKED)), code), date=F.when(~left & text.rlike(T.DATED), T.settled_date(text))))
    rows = marked.groupBy(*PAGE, "line_id").agg(
        F.min_by("pack", F.when(F.col("pack").isNotNull(), F.col("x"))).alias("pack"), F.max_by("date", F.when(F.col("date").isNotNull(), F.col("x"))).alias("date"),
        _joined(F.col("pack").isNull() & F.col("date").isNull()).alias("name"), F.avg("confidence").alias("confidence"), F.max("lone").alias("lone"),
    )
    return _numbered(rows.where("pack IS NOT NULL OR lone"), [F.coalesce("pack", F.lit("")), F.col("name"), F.coalesce("date", F.lit(""))])


def stated_packs(words: DataFrame) -> DataFrame:
    """(doc, page, stated): the printed number of settled packs."""
    line = group_lines(words).groupBy(*PAGE, "line_id").agg(_joined(F.lit(True)).alias("text"))
    n = F.regexp_extract("text", r"(?i)packs?\s*total\s*settled\s*:?\s*([0-9]{1,4})", 1)
    return line.where(n != "").groupBy(*PAGE).agg(F.min_by(n.cast("int"), "line_id").alias("stated"))


def invoice(words: DataFrame) -> DataFrame:
    """(doc, page, row, cells, confidence): label and amount; the amount is the rightmost in the right half."""
    lines = _page_right(group_lines(words))
    side = (F.col("x") >= 0.5 * F.col("page_right")) & (~F.col("text").rlike("^[0-9]+$") | (F.col("x") >= 0.68 * F.col("page_right")))
    marked = once(lines, amount=F.when(side, T.invoice_amount(F.col("text"))))
    at = F.max(F.when(F.col("amount").isNotNull(), F.col("x"))).over(W.partitionBy(*PAGE, "line_id"))
    marked = marked.withColumn("at", at).where("at IS NOT NULL")
    rows = marked.groupBy(*PAGE, "line_id").agg(_joined(F.col("x") + F.col("width") <= F.col("at") + 2).alias("label"), F.max(F.when(F.col("x") == F.col("at"), F.col("amount"))).alias("value"), F.avg("confidence").alias("confidence"))
    return _numbered(rows, [F.col("label"), F.col("value")])


def _count_titles(lines: DataFrame, titles: tuple[str, ...]) -> DataFrame:
    """(doc, page, line_id, centres): each page's first line with all ``titles``; of one that repeats the last place."""
    which = [F.when(T.looks_like(F.col("text"), t), i) for i, t in enumerate(titles)]
    spots = lines.withColumn("pos", F.coalesce(*which)).where("pos IS NOT NULL").groupBy(*PAGE, "line_id", "pos").agg(F.max("centre").alias("centre"))
    heads = spots.groupBy(*PAGE, "line_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "centre"))).alias("centres"))
    first = W.partitionBy(*PAGE).orderBy("line_id")
    return heads.where(F.size("centres") == len(titles)).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def inventory(words: DataFrame, titles: tuple[str, ...] = ("Int", "Rec", "Act", "Set")) -> DataFrame:
    """(doc, page, row, cells, confidence): Game, Name and four counts under their titles.

    A count belongs to the nearest title within three quarters of the titles' pitch; one
    of fewer than three digits is padded with zeros, an unreadable one is empty.
    """
    lines = _page_right(group_lines(words)).withColumn("centre", F.col("x") + F.col("width") / 2)
    heads = _count_titles(lines, titles).select(*PAGE, F.col("line_id").alias("header"), F.transform(F.sequence(F.lit(0), F.lit(len(titles) - 1)), lambda i: F.element_at("centres", i)).alias("centres"))
    body = lines.join(heads, PAGE).where("line_id > header").withColumn("pitch", (F.element_at("centres", -1) - F.element_at("centres", 1)) / (len(titles) - 1))
    pairs = F.transform("centres", lambda c, i: F.struct(F.abs(F.col("centre") - c).alias("d"), (-i).alias("later")))
    best = F.array_min(pairs)
    digits = T.count_digits(F.col("text"))
    is_count = (best["d"] <= 0.75 * F.col("pitch")) & (F.col("x") > 0.45 * F.col("page_right"))
    marked = body.withColumns({"pos": F.when(is_count, -best["later"]), "digits": digits})
    game = F.col("text").rlike("^[0-9]{3}$") & (F.col("x") <= 0.45 * F.col("page_right")) & (F.col("nth") == 0)
    total = T.is_totals(F.col("text"))
    marked = marked.withColumns({"game": F.when(game, F.col("text")), "total": total & F.col("pos").isNull()})
    rows = marked.groupBy(*PAGE, "line_id").agg(
        F.max("game").alias("game"), F.max("total").alias("total"), _joined(F.col("pos").isNull() & F.col("game").isNull()).alias("name"), F.avg("confidence").alias("confidence"),
        *(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("pos") == i, F.struct("x", "digits")))), lambda s: s["digits"]), "").alias(f"c{i}") for i in range(len(titles))),
    ).where("game IS NOT NULL OR total")
    counts = [F.when(F.col(f"c{i}").rlike("^[0-9]{1,3}$"), F.lpad(f"c{i}", 3, "0")).otherwise("") for i in range(len(titles))]
    return _numbered(rows, [F.coalesce("game", F.lit("")), T.repair_game_name(F.col("name")), *counts])
