"""One document from its pages: a common set of columns, CSV and JSON, extra tables.

Titles are data, never Spark columns: the n-th occurrence of a title on a page is the
n-th occurrence of it in the document. export_pages rows: (doc, page, kind, headers,
rows array<array<string>>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.functions import text as T


def with_all_headers(pages: DataFrame) -> DataFrame:
    """Headers padded to the widest row with ``Column i``."""
    width = F.greatest(F.size("headers"), F.coalesce(F.array_max(F.transform("rows", F.size)), F.lit(0)))
    more = F.when(width > F.size("headers"), F.transform(F.sequence(F.size("headers") + 1, width), lambda i: F.concat(F.lit("Column "), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return pages.withColumn("headers", F.concat("headers", more))


def occurrences(pages: DataFrame) -> DataFrame:
    """(doc, page, pos, title, nth): each column of each page and which occurrence of its title it is."""
    cols = with_all_headers(pages).select("doc", "page", F.posexplode("headers").alias("pos", "title"))
    return cols.withColumn("nth", F.row_number().over(W.partitionBy("doc", "page", "title").orderBy("pos")) - 1)


def document_layout(pages: DataFrame) -> DataFrame:
    """(doc, ord, title, nth, key): the document's columns in order of first sight.

    Pages with rows decide; where no page of a document has any, all do.
    """
    full = F.max((F.size("rows") > 0).cast("int")).over(W.partitionBy("doc"))
    source = pages.withColumn("_any", full).where((F.size("rows") > 0) | (F.col("_any") == 0)).drop("_any")
    first = occurrences(source).groupBy("doc", "title", "nth").agg(F.min(F.struct("page", "pos")).alias("at"))
    ord_ = F.row_number().over(W.partitionBy("doc").orderBy("at")) - 1
    key = F.when(F.col("nth") == 0, F.col("title")).otherwise(F.concat("title", F.lit(" ("), (F.col("nth") + 1).cast("string"), F.lit(")")))
    return first.select("doc", ord_.alias("ord"), "title", "nth", key.alias("key"))


def document_kinds(pages: DataFrame) -> DataFrame:
    """(doc, kind): the kind of the pages with rows (of all, where none has any), ``mixed`` where they differ."""
    full = F.max((F.size("rows") > 0).cast("int")).over(W.partitionBy("doc"))
    return pages.withColumn("_any", full).where((F.size("rows") > 0) | (F.col("_any") == 0)).groupBy("doc").agg(F.when(F.count_distinct("kind") > 1, "mixed").otherwise(F.min("kind")).alias("kind"))


def export_cells(pages: DataFrame) -> DataFrame:
    """(doc, page, row, ord, key, value): every cell under its document column."""
    layout = document_layout(pages)
    cells = pages.select("doc", "page", F.posexplode("rows").alias("row", "cells")).select("doc", "page", "row", F.posexplode("cells").alias("pos", "value"))
    at = occurrences(pages).join(layout, ["doc", "title", "nth"]).select("doc", "page", "pos", "ord", "key")
    return cells.join(at, ["doc", "page", "pos"]).select("doc", "page", "row", "ord", "key", "value")


def export_rows(pages: DataFrame) -> DataFrame:
    """(doc, page, row, cells): rows aligned to the document's columns, blanks where a page has none."""
    layout = document_layout(pages).withColumn("width", F.count("*").over(W.partitionBy("doc")).cast("int"))
    places = occurrences(pages).join(layout, ["doc", "title", "nth"]).groupBy("doc", "page").agg(F.map_from_entries(F.collect_list(F.struct(F.col("ord").cast("int").alias("ord"), "pos"))).alias("places"), F.first("width").alias("width"))
    # a page is one row until it has met its columns' places
    rows = pages.select("doc", "page", "rows").join(places, ["doc", "page"]).select("doc", "page", "places", "width", F.posexplode("rows").alias("row", "own")).where(F.size("own") > 0)
    cells = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.try_element_at("own", F.try_element_at("places", i.cast("int")) + 1), F.lit("")))
    return rows.select("doc", "page", "row", cells.alias("cells"))


def page_key(layout: DataFrame) -> DataFrame:
    """(doc, page_title, page_key): names for the page column that no printed title takes."""
    taken = layout.groupBy("doc").agg(F.collect_set("key").alias("keys"), F.collect_set("title").alias("titles"))
    csv = F.when(F.array_contains("titles", "Page"), "PDF Page").otherwise("Page")
    js = F.when(F.array_contains("keys", "page"), "pdfPage").otherwise("page")
    return taken.select("doc", csv.alias("page_title"), js.alias("page_key"))


def document_csv(pages: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc, csv): CRLF between lines, none at the end; the page column only in documents of several pages.

    totals: (doc, total), pages in the document, read or not.
    """
    layout = document_layout(pages)
    line = lambda cells: F.array_join(F.transform(cells, T.csv_field), ",")
    heads = layout.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "title"))), lambda s: s["title"]).alias("titles"))
    rows = export_rows(pages).join(totals, "doc").select("doc", "page", "row", line(F.when(F.col("total") > 1, F.concat(F.array(F.col("page").cast("string")), F.col("cells"))).otherwise(F.col("cells"))).alias("line"))
    body = rows.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("page", "row", "line"))), lambda s: s["line"]).alias("lines"))
    named = heads.join(page_key(layout), "doc").join(totals, "doc").join(body, "doc", "left")
    head = line(F.when(F.col("total") > 1, F.concat(F.array("page_title"), F.col("titles"))).otherwise(F.col("titles")))
    return named.select("doc", F.array_join(F.concat(F.array(head), F.coalesce("lines", F.array().cast("array<string>"))), "\r\n").alias("csv"))


def row_json(pages: DataFrame) -> DataFrame:
    """(doc, page, row, json): rows keyed by document column, in the document's order."""
    rows = export_cells(pages).groupBy("doc", "page", "row").agg(F.sort_array(F.collect_list(F.struct("ord", "key", "value"))).alias("cs"))
    entries = F.transform("cs", lambda c: F.struct(c["key"], c["value"]))
    return rows.select("doc", "page", "row", F.to_json(F.map_from_entries(entries)).alias("json"))


def missing_pages(pages: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc, page): pages of the document that were not read."""
    return totals.select("doc", F.explode(F.sequence(F.lit(1), F.col("total"))).alias("page")).join(pages.select("doc", "page"), ["doc", "page"], "left_anti")


def extra_tables(tables: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """(doc, key, title, slug, headers, ord, rows): tables beside the main one, merged over pages by title and headers.

    tables: (doc, page, pos, title?, headers, rows). A table without a title takes its
    first header, else its place. ``dropped``: (doc, key) to leave out.
    """
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif(F.try_element_at("headers", F.lit(1)), F.lit("")), F.concat(F.lit("Table "), (F.col("pos") + 2).cast("string")))
    keyed = tables.withColumn("title", title).withColumn("key", F.concat_ws("\u0000", "title", F.array_join("headers", "\u0000")))
    rows = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("page", "pos", "rows"))), lambda t: F.transform(t["rows"], lambda r: F.struct(t["page"].alias("page"), r.alias("cells")))))
    merged = keyed.groupBy("doc", "key", "title", "headers").agg(F.min(F.struct("page", "pos")).alias("at"), rows.alias("rows"))
    out = merged.withColumn("ord", F.row_number().over(W.partitionBy("doc").orderBy("at")) - 1).withColumn("slug", T.slugify(F.col("title"))).drop("at")
    return out.join(dropped, ["doc", "key"], "left_anti") if dropped is not None else out


def _quoted(text: Column) -> Column:
    """A JSON string."""
    shown = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(shown, F.lit(2), F.length(shown) - 2))


def _pairs(keys: Column, cells: Column) -> Column:
    """Members of a JSON object, cells by place; of keys that repeat, the last one's cell."""
    cell = lambda k: F.coalesce(F.try_element_at(cells, (F.size(keys) - F.array_position(F.reverse(keys), k) + 1).cast("int")), F.lit(""))
    return F.array_join(F.transform(F.array_distinct(keys), lambda k: F.concat(_quoted(k), F.lit(":"), _quoted(cell(k)))), ",")


def _member(name: str, value: Column) -> Column:
    """A member with its comma, nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f',"{name}":'), value), F.lit(""))


def _fitted(headers: Column, cells: Column) -> Column:
    return F.transform(headers, lambda _, i: F.coalesce(F.try_element_at(cells, i + 1), F.lit("")))


def table_csv(extra: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc, key, csv): each of ``extra_tables`` by itself, with its pages in documents of several."""
    paged = F.col("total") > 1
    page = F.when(F.array_contains("headers", "Page"), "PDF Page").otherwise("Page")
    line = lambda cells: F.array_join(F.transform(cells, T.csv_field), ",")
    head = F.when(paged, F.concat(F.array(page), F.col("headers"))).otherwise(F.col("headers"))
    row = lambda r: F.when(paged, F.concat(F.array(r["page"].cast("string")), _fitted(F.col("headers"), r["cells"]))).otherwise(_fitted(F.col("headers"), r["cells"]))
    lines = F.concat(F.array(line(head)), F.transform("rows", lambda r: line(row(r))))
    return extra.join(totals, "doc").select("doc", "key", F.array_join(lines, "\r\n").alias("csv"))


def table_json(extra: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc, key, ord, json): the same as JSON; a column titled page takes the page's place."""
    paged = (F.col("total") > 1) & ~F.array_contains("headers", "page")
    row = lambda r: F.concat(F.lit("{"), F.when(paged, F.concat(F.lit('"page":'), r["page"].cast("string"), F.when(F.size("headers") > 0, ",").otherwise(""))).otherwise(""), _pairs(F.col("headers"), r["cells"]), F.lit("}"))
    rows = F.concat(F.lit("["), F.array_join(F.transform("rows", row), ","), F.lit("]"))
    json = F.concat(F.lit('{"title":'), _quoted(F.col("title")), _member("headers", F.to_json("headers")), _member("rows", rows), F.lit("}"))
    return extra.join(totals, "doc").select("doc", "key", "ord", json.alias("json"))


def document_json(pages: DataFrame, totals: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(doc, json): one page in its own shape, several under the document's columns.

    pages have a ``title`` (null or blank where none is printed); ``extra`` is the result
    of ``extra_tables``. Documents without a page have no row.
    """
    layout = document_layout(pages)
    first = pages.groupBy("doc").agg(F.min_by(F.struct("kind", "headers", "rows"), "page").alias("p"), F.min_by("title", F.when(F.coalesce("title", F.lit("")) != "", F.col("page"))).alias("title"), F.min_by(F.nullif("title", F.lit("")), "page").alias("own"))
    keys = layout.groupBy("doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "key"))), lambda s: s["key"]).alias("keys")).join(page_key(layout), "doc")
    line = F.concat(F.lit("{"), _quoted(F.col("page_key")), F.lit(":"), F.col("page").cast("string"), F.lit(","), _pairs(F.col("keys"), F.col("cells")), F.lit("}"))
    body = export_rows(pages).join(keys, "doc").select("doc", "page", "row", line.alias("line")).groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "row", "line"))), lambda s: s["line"]), ",").alias("lines"))
    missing = missing_pages(pages, totals).groupBy("doc").agg(F.to_json(F.sort_array(F.collect_list("page"))).alias("missing"))
    whole = first.join(totals, "doc").join(document_kinds(pages), "doc").join(keys, "doc", "left").join(body, "doc", "left").join(missing, "doc", "left")
    tables = F.lit(None).cast("string")
    if extra is not None:
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "json"))), lambda t: t["json"]), ",")
        whole = whole.join(table_json(extra, totals).groupBy("doc").agg(F.concat(F.lit("["), joined, F.lit("]")).alias("_tables")), "doc", "left")
        tables = F.col("_tables")
    rows = F.array_join(F.transform("p.rows", lambda r: F.concat(F.lit("{"), _pairs(F.col("p.headers"), r), F.lit("}"))), ",")
    listed = lambda c: F.concat(F.lit("["), F.coalesce(c, F.lit("")), F.lit("]"))
    one = F.concat(F.lit('{"kind":'), _quoted(F.col("p.kind")), _member("title", _quoted(F.col("own"))), _member("headers", F.to_json("p.headers")), _member("rows", listed(rows)), _member("tables", tables), F.lit("}"))
    many = F.concat(
        F.lit('{"kind":'), _quoted(F.col("kind")), _member("title", _quoted(F.col("title"))), _member("pages", F.col("total").cast("string")), _member("missingPages", F.col("missing")),
        _member("headers", F.coalesce(F.to_json("keys"), F.lit("[]"))), _member("rows", listed(F.col("lines"))), _member("tables", tables), F.lit("}"),
    )
    return whole.select("doc", F.when(F.col("total") > 1, many).otherwise(one).alias("json"))
