"""From words to a document: every page read by its kind, its export page, and the log of what was left out.

The four readers share the words' exchange on (doc, page); what a page is follows from
what each of them found on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.sources.rest import at_rest, dealt

from . import checks, column_tables, export, inventories, readers, skips, tables, titles
from .geometry import LINED, PAGE, group_lines
from .headers import LEAST_COLUMNS, title_word

CELLS = "array<struct<row: int, cells: array<string>, confidence: double>>"
#: What a page reads as when it holds no words.
BLANK, NO_READER = "No words were read. The page may be blank after watermark removal.", "This page is a scan and no recogniser is available to read it."


def choose_source(pages: DataFrame, layer: DataFrame, recognised: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Words of each page and (doc, page, reader): the text layer where it is usable, else the recogniser's words, else none.

    layer: words of text layers; recognised: words of any recogniser, glyphs merged, of as many pages as it read.
    """
    from tablewright.sources.pages import usable_pages

    good = usable_pages(layer).withColumn("reader", F.lit("pdf text"))
    other = "none" if recognised is None else "recogniser"
    chosen = pages.select(*PAGE).distinct().join(good, PAGE, "left").fillna(other, ["reader"])
    words = layer.join(good.select(*PAGE), PAGE, "left_semi")
    if recognised is not None:
        words = words.unionByName(recognised.join(good.select(*PAGE), PAGE, "left_anti"))
    return words, chosen


def _gathered(rows: DataFrame, name: str) -> DataFrame:
    cells = F.sort_array(F.collect_list(F.struct(F.col("row").cast("int").alias("row"), "cells", F.col("confidence").cast("double").alias("confidence"))))
    return rows.groupBy(*PAGE).agg(cells.cast(CELLS).alias(name))


def read_all(words: DataFrame, pages: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, their further tables, and the lines left out.

    Pages: (doc, page, kind, title, headers, rows, confidences, warnings), one row a page of
    ``pages``, else of ``words``. Further tables: (doc, page, pos, title, headers, rows).
    Left out: (doc, page, reason, text, confidence, y, x) of the pages that read as tables.

    A column table wins on a page with its own titles, or with an item under inherited
    ones, unless the titles or marks are those of an inventory, of settlements or of a
    weekly invoice; then the numbers of rows decide (``checks.choose_kind``). Words are
    put to rest once, told page by page in one pass, and dealt by page; their lines are found once, and again only by readers that
    leave words without extent out, where there are such. What each reader found is put
    to rest, so that the last plan joins one row a page of each.
    """
    words = at_rest(words)
    said = F.trim("text") != ""
    told = at_rest(words.groupBy(*PAGE).agg(F.count("*").alias("n"), F.coalesce(F.max(said), F.lit(False)).alias("_read"), F.count_if(said & ~F.coalesce(column_tables.sound(), F.lit(False))).alias("unsound"), F.count_if(said & title_word()).alias("hits")))
    n, unsound = told.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("unsound"), F.lit(0))).first()
    lines = at_rest(group_lines(dealt(words.where(said), n, *PAGE)).withColumn(LINED, F.lit(True)))
    usable = dealt(lines, n, *PAGE)
    sound = usable if unsound == 0 else usable.drop(LINED, "line_id", "nth")
    # a document without a page of enough title words has no table, neither under its own titles nor under others
    with_titles = told.where(F.col("hits") >= LEAST_COLUMNS).select("doc").distinct()
    within = dealt(at_rest(told.join(with_titles, "doc", "left_semi").select(*PAGE)), n, *PAGE)
    found = at_rest(column_tables.read_tables(sound.join(within, PAGE, "left_semi")))
    slim = F.transform("rows", lambda r: F.struct(r["row"].alias("row"), r["cells"].alias("cells"), r["confidence"].alias("confidence")))
    table = found.where("nth = 0").select(*PAGE, F.col("headers").alias("printed"), slim.cast(CELLS).alias("table"))
    heads = at_rest(inventories.count_titles(usable))
    stock = at_rest(inventories.anchored_inventory(sound, rows=n, heads=heads if unsound == 0 else None))
    some = F.exists(F.slice("cells", 3, 4), lambda c: c != "")
    counted = stock.where(some).groupBy(*PAGE).agg(F.count("*").alias("n_stock"), F.max(T.is_totals(F.element_at("cells", 2)).cast("int")).alias("n_totals"))
    weekly = tables.weekly_invoices(usable).withColumn("weekly", F.lit(True))
    titled = heads.select(*PAGE).withColumn("stocked", F.lit(True))
    every = (told if pages is None else pages).select(*PAGE).distinct()
    read = told.where("_read").select(*PAGE, "_read")
    for part in (table, counted, _gathered(stock, "stock"), _gathered(readers.settlements(usable), "packs"), _gathered(readers.invoice(usable), "amounts"), weekly, titled, read):
        every = every.join(at_rest(part), PAGE, "left")
    size = lambda c: F.greatest(F.size(F.coalesce(c, F.array().cast(CELLS))), F.lit(0))
    is_table = F.col("printed").isNotNull() & ~titles.lottery_titles(F.col("printed")) & F.col("stocked").isNull() & F.col("weekly").isNull()
    other = checks.choose_kind(F.coalesce("n_stock", F.lit(0)), F.coalesce("n_totals", F.lit(0)) > 0, size(F.col("packs")), size(F.col("amounts")))
    kinds = at_rest(every.withColumn("kind", F.when(F.coalesce(is_table, F.lit(False)), "table").otherwise(other)))
    rows = F.when(F.col("kind") == "table", F.col("table")).when(F.col("kind") == "inventory", F.col("stock")).when(F.col("kind") == "settlements", F.col("packs")).otherwise(F.col("amounts"))
    headers = F.when(F.col("kind") == "table", F.col("printed")).otherwise(titles.default_headers(F.col("kind")))
    named = kinds.withColumn("_rows", F.coalesce(rows, F.array().cast(CELLS))).join(at_rest(tables.page_titles(usable, kinds.select(*PAGE, "kind"))), PAGE, "left")
    made = named.select(
        *PAGE, "kind", "title", headers.alias("headers"), F.transform("_rows", lambda r: r["cells"]).alias("rows"), F.transform("_rows", lambda r: r["confidence"]).alias("confidences"),
        F.when(F.col("_read").isNull(), F.array(F.lit(BLANK))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )
    tabled = found.join(kinds.where("kind = 'table'").select(*PAGE), PAGE, "left_semi")
    extra = tabled.where("nth > 0").select(*PAGE, (F.col("nth") - 1).alias("pos"), F.coalesce("title", F.lit("")).alias("title"), "headers", F.transform("rows", lambda r: r["cells"]).alias("rows"))
    body = tabled.where("nth = 0").select(*PAGE, "body_left")
    return made, extra, skips.refine(column_tables.left_out(tabled), body)


def read_pages(words: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """The pages of ``read_all``."""
    return read_all(words, pages)[0]


def failures(pages: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc, page, message): pages of the document without a reading."""
    return export.missing_pages(pages, totals).withColumn("message", F.lit("no reading"))


def notices(pages: DataFrame) -> DataFrame:
    """(doc, notices): warnings of all pages in order, each once."""
    listed = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("page", "warnings"))), lambda p: p["warnings"]))
    return pages.groupBy("doc").agg(F.array_distinct(listed).alias("notices"))


def skip_log(skipped: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(doc, ord, page, reason, what, check, text, confidence): every left-out line in the order of pages, failed pages after a page's lines."""
    rows = skipped.select(*PAGE, "reason", "text", "confidence", "y", "x", F.lit(0).alias("_late"))
    if failed is not None:
        none = [F.lit(None).cast("double").alias(c) for c in ("confidence", "y", "x")]
        rows = rows.unionByName(failed.select(*PAGE, F.lit("page-error").alias("reason"), F.col("message").alias("text"), *none, F.lit(1).alias("_late")))
    named = rows.join(F.broadcast(skips.reasons(skipped.sparkSession)).withColumnRenamed("ord", "_o"), "reason", "left")
    order = W.partitionBy("doc").orderBy("page", "_late", "y", "x", "reason", "text")
    return named.select(
        "doc", (F.row_number().over(order) - 1).alias("ord"), "page", "reason", F.coalesce("what", "reason").alias("what"), F.coalesce("check", F.lit(False)).alias("check"), "text", F.round("confidence", 2).alias("confidence"),
    )


def skip_totals(skipped: DataFrame, totals: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(doc, pages, skipped, failed_pages, needs_checking): sums of the log; what needs checking counts printed lines, not times."""
    log = skip_log(skipped, failed)
    sums = log.groupBy("doc").agg(
        F.count("*").alias("skipped"), F.sort_array(F.collect_list(F.when(F.col("reason") == "page-error", F.col("page")))).alias("failed_pages"),
        F.count_distinct(F.when(F.col("check"), F.struct("reason", "text"))).alias("needs_checking"),
    )
    out = totals.select("doc", F.col("total").alias("pages")).join(sums, "doc", "left").fillna(0, ["skipped", "needs_checking"])
    return out.withColumn("failed_pages", F.coalesce("failed_pages", F.array().cast("array<int>")))


def read_document(words: DataFrame, totals: DataFrame, form: str = "json", pages: DataFrame | None = None) -> DataFrame:
    """(doc, json) or (doc, csv) straight from words, further tables included. totals: (doc, total), pages in the document."""
    made, extra, _ = read_all(words, pages)
    gone = extra.sparkSession.createDataFrame([], "doc string, key string")
    return export_pages(made, totals, form=form, extra=export.extra_tables(extra, gone))


def export_pages(
    pages: DataFrame, totals: DataFrame, what: str = "data", form: str = "json", extra: DataFrame | None = None, skipped: DataFrame | None = None, failed: DataFrame | None = None, key: Column | None = None,
) -> DataFrame:
    """What a caller may ask of pages that it holds: ``data``, ``log`` or ``table``, as ``csv`` or ``json``.

    extra: the result of ``export.extra_tables`` without those that were dropped; of them
    ``table`` gives the ones with ``key``, all without it. ``log`` needs ``skipped``.
    """
    if what not in ("data", "log", "table") or form not in ("csv", "json"):
        raise ValueError(f"unknown export: {what} as {form}")
    if what == "log":
        if skipped is None:
            raise ValueError("a log needs the skipped lines")
        if form == "csv":
            return skips.log_csv(skips.log_groups(skipped, failed))
        rows = F.transform(F.sort_array(F.collect_list(F.struct("ord", "page", "reason", "what", "check", "text", "confidence"))), lambda r: r.dropFields("ord"))
        listed = skip_log(skipped, failed).groupBy("doc").agg(rows.alias("rows"))
        whole = skip_totals(skipped, totals, failed).join(listed, "doc", "left")
        shown = F.struct("pages", "skipped", F.when(F.size("failed_pages") > 0, F.col("failed_pages")).alias("failedPages"), F.col("needs_checking").alias("needsChecking"), "rows")
        return whole.select("doc", F.to_json(shown).alias("json"))
    if what == "table":
        if extra is None:
            raise ValueError("a table needs the extra tables")
        wanted = extra if key is None else extra.where(F.col("key") == key)
        return (export.table_csv if form == "csv" else export.table_json)(wanted, totals)
    return export.document_csv(pages, totals) if form == "csv" else export.document_json(pages, totals, extra)
