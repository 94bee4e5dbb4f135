"""Column tables: titles, edges, cells and what every other line is, page by page.

words -> lines -> fields -> header line -> column edges -> cells -> rows and log. The
page chain (a page without titles reads under the last page's edges) is a window over
the document's pages, so pages stay independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.functions.arrays import let, once, share

from .geometry import PAGE, column_index, group_lines, line_fields

# Words that title a column.
TITLES = r"(?i)^(?:qty|quantity|case|unt|unit|item#?|items?|part#?|upc|sku|description|pack|prc|price|extended|amount|total|ordered|shipped|customer|tax|per|oos|qos|sub-?|code|date|dated|invoice#?|balance|charge|credit|debit|category|lines?|units?|cost)$"
LEAST_TITLES = 3


def _edges(fs: Column) -> Column:
    """Edges of titles struct<x, right, text>: the first at most 4 left of its title; the others a pixel left of theirs, or,
    where the gap before is wider than 1.5 of the title before, on that title's shoulder."""

    def edge(f, i):
        before = F.try_element_at(fs, i)  # 1-based: the one before
        gap, label = f["x"] - before["right"], before["right"] - before["x"]
        shoulder = before["right"] + F.least(0.22 * gap, 0.45 * label)
        return F.when(i == 0, F.least(F.lit(0.0), f["x"] - 4)).when(gap > 1.5 * label, shoulder).otherwise(f["x"] - 1)

    return F.transform(fs, edge)


def field_lines(cells: DataFrame) -> DataFrame:
    """One row a line with its fields ``fs``, and whether it has enough titles: (doc, page, line_id, fs, titles, confidence, x, y, bottom, height)."""
    lines = cells.groupBy(*PAGE, "line_id").agg(
        F.sort_array(F.collect_list(F.struct("x", "right", "text"))).alias("fs"), (F.sum(F.col("confidence") * F.col("n_words")) / F.sum("n_words")).alias("confidence"),
        F.min("x").alias("x"), F.min("top").alias("y"), F.max("bottom").alias("bottom"), F.max("height").alias("height"),
    )
    return once(lines, titles=titled(F.col("fs.text")))


def titled(texts: Column) -> Column:
    """Whether a line's fields are enough titles, and none of them an amount."""
    hits = F.size(F.filter(texts, lambda t: t.rlike(TITLES)))
    priced = F.exists(texts, lambda t: t.rlike(r"^\$?[0-9,]*[0-9]\.[0-9]{2}$"))
    return (F.size(texts) >= LEAST_TITLES) & ~priced & (hits >= LEAST_TITLES)


def header_lines(cells: DataFrame) -> DataFrame:
    """(doc, page, line_id, headers, bounds, bottom): each page's first line with enough titles."""
    first = W.partitionBy(*PAGE).orderBy("line_id")
    best = field_lines(cells).where("titles").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return best.select(*PAGE, "line_id", F.transform("fs", lambda f: f["text"]).alias("headers"), _edges(F.col("fs")).alias("bounds"), "bottom")


def guided(lines: DataFrame) -> DataFrame:
    """``lines`` (field_lines) with headers, bounds and ``header_line``: own titles, else those of the last page before that has any.

    A page's first line with titles holds them; the last holder up to and with a page is a
    window over the document's lines, so no page is read twice. ``header_line`` is null on
    pages that inherit; lines of pages with neither go.
    """
    first = F.min(F.when(F.col("titles"), F.col("line_id"))).over(W.partitionBy(*PAGE))
    held = F.when(F.col("line_id") == F.col("header_line"), F.struct(F.transform("fs", lambda f: f["text"]).alias("headers"), _edges(F.col("fs")).alias("bounds")))
    upto = W.partitionBy("doc").orderBy("page").rangeBetween(W.unboundedPreceding, W.currentRow)
    seen = lines.withColumn("header_line", first).withColumn("own", held).withColumn("g", F.last("own", ignorenulls=True).over(upto))
    return seen.where("g IS NOT NULL").select("*", "g.headers", "g.bounds").drop("own", "g", "titles")


def read_lines(words: DataFrame) -> DataFrame:
    """Every line of every page that has or inherits titles, as cells and with its kind.

    (doc, page, line_id, headers, cells, text, confidence, x, y, kind); kind is item,
    header, furniture, rule, repeated-header, summary, label or unplaced. A line is one row
    from its fields on; what later steps name often is computed once a row.
    """
    found = line_fields(group_lines(words.where(F.trim("text") != "")))
    lines = guided(found.withColumn("titles", titled(F.col("fs.text"))))
    # A field belongs where it starts: a long cell may reach past the middle of the next title.
    start = lambda f: F.least((f["x"] + f["right"]) / 2, f["x"] + 1)
    placed = F.transform("fs", lambda f: F.struct(f["x"].alias("x"), f["text"].alias("text"), let(start(f), lambda x: column_index(x, F.col("bounds"))).alias("col")))
    cell = lambda ps, i: F.array_join(F.transform(F.filter(ps, lambda p: p["col"] == i), lambda p: p["text"]), " ")
    spread = let(F.array_sort(placed), lambda ps: F.transform("headers", lambda _, i: cell(ps, i)))
    # the usual line has a field for every title, each between its edge and the next
    within = lambda x, i: (F.get("bounds", i) <= x) & F.coalesce(F.get("bounds", i + 1) > x, F.lit(True))
    each = (F.size("fs") == F.size("headers")) & (F.col("bounds") == F.sort_array("bounds")) & F.forall(F.transform(F.transform("fs", start), within), lambda ok: ok)
    lines = lines.withColumn("printed", F.when(each, F.col("fs.text")).otherwise(spread))
    lines = lines.withColumn("text", F.array_join(F.array_remove("printed", F.lit("")), " "))
    noted = F.col("text").rlike("(?i)stock")  # else no cell holds a note
    lines = lines.withColumn("cells", F.when(noted, F.transform("printed", T.without_stock_notes)).otherwise(F.col("printed")))
    lines = lines.withColumn("item", T.is_line_item(F.col("cells")))
    item, text = F.col("item"), F.col("text")
    lines = lines.withColumns({
        "furniture": F.when(~item, T.is_furniture(text)), "again": T.is_repeated_header(F.col("cells"), F.col("headers")), "summary": T.is_summary(F.col("cells"), item),
    })
    kind = (
        F.when(F.col("line_id") == F.col("header_line"), "header").when(F.col("line_id") < F.col("header_line"), "above")
        .when(~item & F.col("furniture"), "furniture").when(T.is_rule(text), "rule")
        .when(F.col("again"), "repeated-header").when(F.col("summary"), "summary")
        .when(~item & T.is_starred(text) & text.rlike("[A-Za-z]"), "label").when(item, "item").otherwise("unplaced")
    )
    notes = F.when(noted, F.flatten(F.transform("printed", T.stock_notes))).otherwise(F.array().cast("array<string>"))
    return once(lines, kind=kind).select(*PAGE, "line_id", "headers", "cells", "text", notes.alias("notes"), "confidence", "x", "y", "bottom", "height", "kind")


def table_rows(lines: DataFrame) -> DataFrame:
    """(doc, page, row, cells, confidence, label): items and labels, numbered from 0 on their page."""
    row = F.row_number().over(W.partitionBy(*PAGE).orderBy("line_id")) - 1
    return lines.where("kind IN ('item', 'label')").select(*PAGE, row.alias("row"), "headers", "cells", "confidence", (F.col("kind") == "label").alias("label"))


def text_columns(lines: Column) -> Column:
    """Indexes of the columns that ``column_kinds`` calls text, of one page's lines."""
    items = F.filter(lines, lambda l: l["kind"] == "item")

    def texts(items: Column) -> Column:
        filled = lambda i: F.filter(F.transform(items, lambda l: F.try_element_at(l["cells"], i + 1)), lambda c: c != "")
        worded = lambda c: c.rlike("[A-Za-z].*[A-Za-z]")
        is_text = lambda cs: (F.size(cs) > 0) & (share(cs, T.is_figure) < 0.5) & (share(cs, worded) >= 0.5)
        return F.filter(F.sequence(F.lit(0), F.greatest(F.array_max(F.transform(items, lambda l: F.size(l["cells"]))), F.lit(1)) - 1), lambda i: let(filled(i), is_text))

    return F.when(F.size(items) > 0, let(items, texts))


def with_wraps(lines: DataFrame, reach: float = 1.5, most: int = 3) -> DataFrame:
    """``lines`` with ``head``, the line whose row they belong to; continuations get the kind wrap.

    A line continues the one above it if it is unplaced, fills at most ``most`` cells, all
    in text columns, and starts within ``reach`` line heights of the line before. A run of
    them belongs to the item or label it follows; without one, it stays unplaced.
    """
    rest = [c for c in lines.columns if c not in PAGE]
    whole = lines.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("line_id", *[c for c in rest if c != "line_id"]))).alias("ls"))
    lines = once(whole, texts=text_columns(F.col("ls"))).select(*PAGE, "texts", F.inline("ls")).select(*PAGE, *rest, "texts")
    order = W.partitionBy(*PAGE).orderBy("line_id")
    filled = F.filter(F.transform("cells", lambda c, i: F.when(c != "", i)), lambda i: i.isNotNull())
    near = F.col("y") - F.lag("bottom").over(order) <= reach * F.col("height")
    fits = (F.col("kind") == "unplaced") & F.size(filled).between(1, most) & F.forall(filled, lambda i: F.array_contains("texts", i))
    joined = once(lines.withColumn("_near", near), _fits=F.coalesce(fits & F.col("_near"), F.lit(False))).drop("_near")
    head = F.last(F.when(~F.col("_fits"), F.struct("line_id", "kind")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    marked = joined.withColumn("_h", head)
    wraps = F.col("_fits") & F.col("_h.kind").isin("item", "label")
    return marked.withColumn("head", F.when(wraps, F.col("_h.line_id")).otherwise(F.col("line_id"))).withColumn("kind", F.when(wraps, "wrap").otherwise(F.col("kind"))).drop("_fits", "_h", "texts")


def wrapped_rows(lines: DataFrame) -> DataFrame:
    """``table_rows`` with continuation lines appended to the cells of their row; confidence is the first line's."""
    own = with_wraps(lines).where("kind IN ('item', 'label', 'wrap')")
    rows = own.groupBy(*PAGE, F.col("head").alias("line_id")).agg(
        F.sort_array(F.collect_list(F.struct("line_id", "cells"))).alias("ls"), F.first("headers").alias("headers"),
        F.max(F.when(F.col("kind") != "wrap", F.col("confidence"))).alias("confidence"), F.max(F.when(F.col("kind") != "wrap", F.col("kind"))).alias("kind"),
    )
    both = lambda a, b: F.concat_ws(" ", F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))
    cells = F.aggregate(F.slice("ls", 2, F.greatest(F.size("ls") - 1, F.lit(0))), F.col("ls")[0]["cells"], lambda acc, l: F.zip_with(acc, l["cells"], both))
    return table_rows(rows.withColumn("cells", cells))


# Words of a title, by the kind of page, and of any kind; what begins a line that is none; what is less likely one.
KIND_WORDS = {"settlements": "settlements?", "inventory": "inventory", "invoice": "invoice", "table": "invoice|statement|bill|order"}
ANY_WORDS = r"pack\s+settlements?|weekly\s+pack|instant\s+inventory|inventory\s+summary|weekly\s+invoice|settlement\s+report"
NO_TITLE = r"(?i)^https?://|^www\.|^(?:retailer|store|terminal)\b|^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|^(?:game|name|int|rec|act|set|game-pack|date settled)"
UNLIKELY = "(?i)scholarship|lottery"
#: Titles that are recognised without their blank.
GLUED = (("(?i)WEEKLYINVOICE", "WEEKLY INVOICE"), ("(?i)PACKSETTLEMENTS?", "PACK SETTLEMENTS"), ("(?i)INVENTORYSUMMARY", "INVENTORY SUMMARY"))


def clean_title(text: Column) -> Column:
    """Glued titles parted, marks at the ends and blank runs removed."""
    whole = text
    for glued, parted in GLUED:
        text = F.regexp_replace(text, f"^(.*?){glued}", f"$1{parted}")
    return T.squeeze(T.strip_edges(F.when(whole.rlike("|".join(glued for glued, _ in GLUED)), text).otherwise(whole)))


def invoice_heading(text: Column) -> Column:
    """The heading alone where a line holds much more than it: weekly invoice, or an invoice's number; null for other lines."""
    number = F.regexp_extract(text, r"(?i)\binvoice\s*#?\s*:?\s*([0-9]{4,})", 1)
    weekly = text.rlike(r"(?i)\bweekly\s+invoice\b") & (F.length(text) > len("WEEKLY INVOICE") + 4)
    return F.when(weekly, "WEEKLY INVOICE").when((number != "") & (F.length(text) > F.length(number) + len("Invoice # ") + 4), F.concat(F.lit("Invoice # "), number))


def page_titles(words: DataFrame, kind: str | DataFrame = "invoice", lines: int = 16, least: int = 30) -> DataFrame:
    """(doc, page, title): the best scored of the first lines: a word of the kind 50, of any kind 40,
    height up to 30, upper case 15, an unlikely one -20; of equals the first. ``kind``: one of all pages, or (doc, page, kind)."""
    grouped = group_lines(words).where(F.col("line_id") < lines).groupBy(*PAGE, "line_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "text"))), lambda s: s["text"]), " ").alias("raw"), F.avg("height").alias("height")
    )
    text = F.col("text")
    grouped = grouped.withColumn("kind", F.lit(kind)) if isinstance(kind, str) else grouped.join(kind, PAGE)
    own = F.coalesce(*(F.when(F.col("kind") == k, text.rlike(rf"(?i)\b(?:{v})\b")) for k, v in KIND_WORDS.items()), F.lit(False))
    score = F.when(own, 50).otherwise(0) + F.when(text.rlike(rf"(?i)\b(?:{ANY_WORDS})\b"), 40).otherwise(0) + F.least("height", F.lit(30.0))
    score = score + F.when((F.upper(text) == text) & text.rlike("[A-Z]"), 15).otherwise(0) - F.when(text.rlike(UNLIKELY) & ~own, 20).otherwise(0)
    clean = once(grouped, text=clean_title(F.trim("raw"))).where((F.length(text) >= 3) & ~text.rlike(NO_TITLE))
    scored = once(clean, score=score).where(F.col("score") > least)
    best = scored.groupBy(*PAGE).agg(F.max_by("text", F.struct("score", -F.col("line_id"))).alias("title"))
    return best.select(*PAGE, F.coalesce(invoice_heading(F.col("title")), "title").alias("title"))


# Six marks of a weekly invoice, letters and digits only.
WEEKLY_MARKS = ("fwdbalance", "onlinenetdue", "instantnetdue", "totalduebywed", "systemfee", "nongameadjustments")


def weekly_invoices(words: DataFrame, least: int = 2) -> DataFrame:
    """(doc, page) of the pages on which ``least`` marks of a weekly invoice are printed, blanks and marks between words aside."""
    page = words.groupBy(*PAGE).agg(T.flat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "text"))), lambda s: s["text"]), "")).alias("text"))
    marks = sum((F.contains("text", F.lit(m)).cast("int") for m in WEEKLY_MARKS), F.lit(0))
    return once(page, marks=marks).where(F.col("marks") >= least).select(*PAGE)


def skipped_lines(lines: DataFrame) -> DataFrame:
    """(doc, page, reason, text, confidence, y, x): every line left out and why, and notes cut from items."""
    whole = F.when(F.col("kind").isin("furniture", "repeated-header", "summary", "unplaced"), F.array(F.struct(F.col("kind").alias("reason"), "text")))
    notes = F.transform("notes", lambda n: F.struct(F.lit("note").alias("reason"), n.alias("text")))
    told = F.concat(F.coalesce(whole, F.array().cast("array<struct<reason: string, text: string>>")), notes)
    return lines.select(*PAGE, F.inline(told), "confidence", "y", "x").select(*PAGE, "reason", "text", "confidence", "y", "x")


def body_left(lines: DataFrame) -> DataFrame:
    """(doc, page, body_left): median left of the item lines."""
    return lines.where("kind = 'item'").groupBy(*PAGE).agg(F.median("x").alias("body_left"))


def column_kinds(rows: DataFrame) -> DataFrame:
    """(doc, page, col, kind): figure, text or code by what half of a column's filled cells are."""
    cells = rows.where("NOT label").select(*PAGE, F.posexplode("cells").alias("col", "cell")).where("cell <> ''")
    figures, letters = F.avg(T.is_figure(F.col("cell")).cast("int")), F.avg(F.col("cell").rlike("[A-Za-z].*[A-Za-z]").cast("int"))
    return cells.groupBy(*PAGE, "col").agg(F.when(figures >= 0.5, "figure").when(letters >= 0.5, "text").otherwise("code").alias("kind"))
