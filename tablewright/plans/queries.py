"""One query per operator over the driver's tables: relations are printed or shaped, then read back.

Each entry has its SQL beside it: (query, SQL over the same tables).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.functions import display
from tablewright.operators import checks, column_tables, export, geometry, inventories, readers, reading, recogniser, review, skips, tables, titles
from tablewright.operators import words as finding
from tablewright.sources.rest import at_rest, dealt

from .printer import decimal_text, number_pages, print_fields, print_lines, print_table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ITEM_TITLES, ITEM_XS = ["QTY", "ITEM#", "DESCRIPTION", "PRICE", "EXTENDED"], [60.0, 200.0, 400.0, 900.0, 1100.0]
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]

# The printed items and their pages, in SQL.
ITEMS_SQL = """
    items AS (
        SELECT CAST(l_orderkey // 16 AS VARCHAR) AS doc, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS qty, 'P' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS item, p_name AS description,
               CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS price, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS extended,
               row_number() OVER (PARTITION BY l_orderkey // 16 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS n
        FROM lineitem JOIN part ON l_partkey = p_partkey
    )"""


def item_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page, line, cells): 20 line items a page, orders by sixteens a document."""
    rows = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    paged = number_pages(rows, F.expr("cast(l_orderkey div 16 as string)"), LINE_ORDER, 20)
    cells = F.array(F.col("l_quantity").cast("long").cast("string"), F.concat(F.lit("P"), F.lpad(F.col("l_partkey").cast("string"), 7, "0")), F.col("p_name"), decimal_text("p_retailprice"), decimal_text("l_extendedprice"))
    return paged.select("doc", "page", "line", cells.alias("cells"))


def item_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd documents print their titles on the first page only; the others read under them."""
    return print_table(item_pages(spark, sf_dir), ITEM_TITLES, ITEM_XS, (F.col("page") == 1) | (F.col("doc").cast("long") % 2 == 0))


def named(rows: DataFrame, *names: str, col: str = "cells") -> list:
    return [F.element_at(col, i + 1).alias(n) for i, n in enumerate(names)]


@query(f"WITH {ITEMS_SQL} SELECT doc, CAST(n // 20 + 1 AS INT) AS page, CAST(n % 20 AS BIGINT) AS row_no, qty, item, description, price, extended FROM items")
def export_document_rows(spark, sf_dir):
    rows = tables.table_rows(tables.read_lines(item_words(spark, sf_dir)))
    return rows.select("doc", "page", F.col("row").cast("long").alias("row_no"), *named(rows, "qty", "item", "description", "price", "extended"))


@query(f"WITH {ITEMS_SQL} SELECT doc, CAST(n // 20 + 1 AS INT) AS page, CAST(count(*) AS BIGINT) AS items, ['QTY', 'ITEM#', 'DESCRIPTION', 'PRICE', 'EXTENDED'][1] AS first_title FROM items WHERE (CAST(doc AS BIGINT) % 2 = 1) AND n >= 20 GROUP BY ALL")
def read_guided_pages(spark, sf_dir):
    rows = tables.table_rows(tables.read_lines(item_words(spark, sf_dir)))
    guided = rows.where((F.col("page") > 1) & (F.col("doc").cast("long") % 2 == 1))
    return guided.groupBy("doc", "page").agg(F.count("*").alias("items"), F.first(F.element_at("headers", 1)).alias("first_title"))


@query(f"WITH {ITEMS_SQL}, c AS (SELECT 'figure' AS kind, 3 AS k UNION ALL SELECT 'text', 1 UNION ALL SELECT 'code', 1), p AS (SELECT count(DISTINCT (doc, n // 20)) AS pages FROM items) SELECT kind, CAST(k * pages AS BIGINT) AS n FROM c, p")
def column_kinds(spark, sf_dir):
    rows = tables.table_rows(tables.read_lines(item_words(spark, sf_dir)))
    return tables.column_kinds(rows).groupBy("kind").agg(F.count("*").alias("n"))


def noisy_words(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    paged = number_pages(orders, F.expr("cast(o_custkey as string)"), ["o_orderkey"], 10)
    items = paged.select("doc", "page", "line", F.array(F.lit("1"), F.concat(F.lit("ORD"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")), F.col("o_orderstatus"), decimal_text("o_totalprice")).alias("cells"))
    pages = paged.select("doc", "page").distinct()
    blank = F.lit("")
    noise = [
        (20, F.array(blank, F.lit("SUB TOTAL"), blank, F.lit("12.00"))), (21, F.array(F.lit("QTY"), F.lit("ITEM#"), F.lit("STATUS"), F.lit("PRICE"))), (22, F.array(blank, F.lit("STANDING NOTE OF THE HOUSE"), blank, blank)),
        (23, F.array(F.concat(F.lit("PAGE "), F.col("page").cast("string"), F.lit(" OF 9")), blank, blank, blank)), (24, F.array(F.lit("------"), blank, blank, blank)), (25, F.array(blank, F.lit("T DENOTES TAXED GOODS"), blank, blank)),
    ]
    lines = items
    for n, cells in noise:
        lines = lines.unionByName(pages.select("doc", "page", F.lit(n).alias("line"), cells.alias("cells")))
    return print_table(lines, ["QTY", "ITEM#", "STATUS", "PRICE"], [60.0, 260.0, 700.0, 900.0], F.lit(True))


PAGES_SQL = "pages AS (SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 10 AS page FROM orders)"


@query(f"""WITH {PAGES_SQL}, p AS (SELECT o_custkey, page, max(page) OVER (PARTITION BY o_custkey) AS last FROM (SELECT DISTINCT * FROM pages)),
    l AS (SELECT unnest(['summary', 'repeated-header', 'furniture', CASE WHEN last > 0 THEN 'page-field' ELSE 'unplaced' END, CASE WHEN last > 0 THEN 'page-field' ELSE 'legend' END]) AS reason FROM p)
    SELECT reason, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY reason""")
def read_skip_log(spark, sf_dir):
    lines = at_rest(tables.read_lines(noisy_words(spark, sf_dir)))
    found = skips.refine(tables.skipped_lines(lines), tables.body_left(lines))
    # what is left unplaced lies right of the items; alone in its document it has no shared indent
    return found.groupBy("reason").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT o_custkey // 8 AS doc, o_orderkey, o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey // 8 ORDER BY o_orderkey) - 1 AS n FROM orders)
    SELECT CAST(doc AS VARCHAR) AS doc, CAST(n // 25 + 1 AS INT) AS page, CAST(n % 25 AS BIGINT) AS row_no, lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS pack,
        'GAME ' || CAST(o_custkey AS VARCHAR) AS name, strftime(o_orderdate, '%m/%d/%y') AS settled FROM d""")
def read_settlements(spark, sf_dir):
    rows = readers.settlements(settlement_words(spark, sf_dir))
    return rows.select("doc", "page", F.col("row").cast("long").alias("row_no"), *named(rows, "pack", "name", "settled"))


def settlement_words(spark, sf_dir):
    paged = number_pages(load(spark, sf_dir, "orders"), F.expr("cast(o_custkey div 8 as string)"), ["o_orderkey"], 25)
    pack = F.concat(F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0"))
    rows = paged.select("doc", "page", "line", F.array(pack, F.concat(F.lit("GAME "), F.col("o_custkey").cast("string")), F.date_format("o_orderdate", "MM/dd/yy")).alias("cells"))
    count = paged.groupBy("doc", "page").agg(F.count("*").alias("n")).select("doc", "page", F.lit(30).alias("line"), F.array(F.lit(""), F.concat(F.lit("Packs Total Settled: "), (F.col("n") + F.when(F.col("page") == 1, 1).otherwise(0)).cast("string")), F.lit("")).alias("cells"))
    return print_table(rows.unionByName(count), ["Game-Pack", "Name", "Date Settled"], [60.0, 300.0, 900.0], F.lit(True))


@query("""WITH d AS (SELECT o_custkey // 8 AS doc, (row_number() OVER (PARTITION BY o_custkey // 8 ORDER BY o_orderkey) - 1) // 25 AS page FROM orders)
    SELECT CAST(doc AS VARCHAR) AS doc, CAST(page + 1 AS INT) AS page, 'settlements-count' AS code, CAST(count(*) + 1 AS INT) AS stated, CAST(count(*) AS BIGINT) AS n FROM d WHERE page = 0 GROUP BY ALL""")
def validate_settlements(spark, sf_dir):
    words = settlement_words(spark, sf_dir)
    rows, stated = at_rest(readers.settlements(words)), at_rest(readers.stated_packs(words))
    n = rows.groupBy("doc", "page").agg(F.count("*").alias("n"))
    return checks.settlement_issues(rows, stated).join(stated, ["doc", "page"]).join(n, ["doc", "page"]).select("doc", "page", "code", "stated", "n")


def stock_counts(spark, sf_dir):
    """(doc, page, line, game, name, c0..c3): four counts a part; dealt by document for the about ten words that a part prints."""
    sold = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"), F.max("l_linenumber").cast("long").alias("m"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    parts = load(spark, sf_dir, "part")
    found = parts.join(sold, F.col("p_partkey") == F.col("l_partkey")).withColumn("doc", F.expr("cast(p_partkey div 20 as string)"))
    paged = number_pages(dealt(found, parts.count() * 10, "doc"), F.col("doc"), ["p_partkey"], 20)
    return paged.select("doc", "page", "line", F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0").alias("game"), F.upper("p_name").alias("name"), *((F.col(c) % 45).alias(f"c{i}") for i, c in enumerate("nqmr")))


STOCK_SQL = """stock AS (SELECT p_partkey // 20 AS doc, p_partkey, row_number() OVER (PARTITION BY p_partkey // 20 ORDER BY p_partkey) - 1 AS line, lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS game, upper(p_name) AS name,
        n % 45 AS c0, q % 45 AS c1, m % 45 AS c2, r % 45 AS c3
    FROM part JOIN (SELECT l_partkey, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS q, max(l_linenumber) AS m, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey)"""


def stock_rows(spark, sf_dir, blank: bool, off: int = 0):
    """(doc, page, line, cells) with a TOTALS row; ``blank`` leaves one count of each column out, ``off`` is added to Act's total."""
    page = W.partitionBy("doc", "page")
    rows = stock_counts(spark, sf_dir).withColumns({"last": F.max("line").over(page), **{f"s{i}": F.sum(f"c{i}").over(page) for i in range(4)}})
    three = lambda c: F.lpad(c.cast("string"), 3, "0")
    shown = [F.when(F.lit(blank) & (F.col("line") == i), "").otherwise(three(F.col(f"c{i}"))) for i in range(4)]
    total = _line(F.lit(25), F.lit(""), F.lit("TOTALS"), *(three(F.col(f"s{i}") + (off if i == 2 else 0)) for i in range(4)))
    return _with_last(rows, _line(F.col("line"), F.col("game"), F.col("name"), *shown), total)


def _line(line, *cells):
    return F.struct(line.cast("int").alias("line"), F.array(*cells).alias("cells"))


def _with_last(rows, own, *closing):
    """(doc, page, line, cells): each row's own line; a page's last row (``last``) carries the lines that close its page."""
    return rows.select("doc", "page", F.inline(F.when(F.col("line") == F.col("last"), F.array(own, *closing)).otherwise(F.array(own))))


@query(f"WITH {STOCK_SQL} SELECT CAST(doc AS VARCHAR) AS doc, CAST(line AS BIGINT) AS row_no, game, name, lpad(CAST(c0 AS VARCHAR), 3, '0') AS c_int, lpad(CAST(c1 AS VARCHAR), 3, '0') AS c_rec, lpad(CAST(c2 AS VARCHAR), 3, '0') AS c_act, lpad(CAST(c3 AS VARCHAR), 3, '0') AS c_set FROM stock")
def read_inventory(spark, sf_dir):
    words = print_table(stock_rows(spark, sf_dir, False), ["Game", "Name", "Int", "Rec", "Act", "Set"], [60.0, 160.0, 600.0, 700.0, 800.0, 900.0], F.lit(True))
    rows = readers.inventory(words)
    return rows.where(F.element_at("cells", 1) != "").select("doc", F.col("row").cast("long").alias("row_no"), *named(rows, "game", "name", "c_int", "c_rec", "c_act", "c_set"))


def damaged_stock(spark, sf_dir):
    """Words of stock pages that slope into the next row; some rows glue their counts, some leave zeros out; every other page prints no titles."""
    shown = stock_counts(spark, sf_dir).withColumn("last", F.max("line").over(W.partitionBy("doc", "page")))
    three = lambda i: F.lpad(F.col(f"c{i}").cast("string"), 3, "0")
    glued, short = F.col("game").cast("int") % 5 == 1, F.col("game").cast("int") % 7 == 2
    counts = [F.when(glued, F.concat(*map(three, range(4))) if i == 0 else F.lit("")).when(short, F.col(f"c{i}").cast("string")).otherwise(three(i)) for i in range(4)]
    total = _line(F.col("last") + 1, *map(F.lit, ("", "TOTALS", "000", "000", "000", "000")))
    below = _line(F.col("last") + 3, *map(F.lit, ("123", "FOOTER", "001", "002", "003", "004")))
    words = print_table(_with_last(shown, _line(F.col("line"), F.col("game"), F.col("name"), *counts), total, below), ["Game", "Name", "Int", "Rec", "Act", "Set"], [60.0, 160.0, 700.0, 800.0, 900.0, 1000.0], F.col("doc").cast("long") % 2 == 0)
    return words.withColumn("y", F.when(F.col("y") > 100, F.col("y") + (F.col("x") - 60) * 0.022).otherwise(F.col("y")))


@query(f"""WITH {STOCK_SQL}, n AS (SELECT doc, max(line) + 1 AS last FROM stock GROUP BY doc)
SELECT CAST(doc AS VARCHAR) AS doc, CAST(line AS BIGINT) AS row_no, game, name, lpad(CAST(c0 AS VARCHAR), 3, '0') AS c_int, lpad(CAST(c1 AS VARCHAR), 3, '0') AS c_rec, lpad(CAST(c2 AS VARCHAR), 3, '0') AS c_act, lpad(CAST(c3 AS VARCHAR), 3, '0') AS c_set FROM stock
UNION ALL SELECT CAST(doc AS VARCHAR), CAST(last AS BIGINT), '', 'TOTALS', '000', '000', '000', '000' FROM n""")
def anchored_inventory(spark, sf_dir):
    """Rows come back whole although lines run into each other; nothing below TOTALS is read."""
    rows = inventories.anchored_inventory(damaged_stock(spark, sf_dir))
    return rows.select("doc", F.col("row").cast("long").alias("row_no"), *named(rows, "game", "name", "c_int", "c_rec", "c_act", "c_set"))


def _counts(spark, sf_dir, blank, off=0):
    rows = stock_rows(spark, sf_dir, blank, off).withColumnRenamed("line", "row")
    return checks.count_columns(rows)


@query(f"WITH {STOCK_SQL}, u AS (UNPIVOT (SELECT doc, line, CAST(c0 AS BIGINT) AS c0, CAST(c1 AS BIGINT) AS c1, CAST(c2 AS BIGINT) AS c2, CAST(c3 AS BIGINT) AS c3 FROM stock) ON c0, c1, c2, c3 INTO NAME pos VALUE n) SELECT CAST(doc AS VARCHAR) AS doc, CAST(line AS BIGINT) AS row_no, CAST(right(pos, 1) AS INT) AS pos, n, line = CAST(right(pos, 1) AS INT) AS solved FROM u")
def solve_inventory(spark, sf_dir):
    solved = checks.solve_counts(_counts(spark, sf_dir, True))
    return solved.where("NOT totals").select("doc", F.col("row").cast("long").alias("row_no"), "pos", F.col("count").cast("long").alias("n"), "solved")


@query(f"WITH {STOCK_SQL} SELECT CAST(doc AS VARCHAR) AS doc, 'inventory-totals' AS code, 25 AS row_no FROM stock GROUP BY doc")
def validate_inventory(spark, sf_dir):
    issues = checks.inventory_issues(checks.solve_counts(_counts(spark, sf_dir, False, 7)))
    return issues.select("doc", "code", F.element_at("rows", 1).alias("row_no"))


def invoice_fields(spark, sf_dir):
    """(doc, page, row, label, value): six parts and a total, off by a cent for every third customer."""
    cust = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc"), F.lit(1).alias("page"), (F.floor(F.abs("c_acctbal") * 100 + 0.5)).cast("long").alias("b"), (F.col("c_custkey") % 3 == 0).alias("off")).repartition("doc")
    labels = ["FWD BALANCE", "ON-LINE NET DUE", "INSTANT NET DUE", "NON-GAME ADJUSTMENTS", "SYSTEM FEE", "OTHER RETAILER INCENTIVES"]
    signs = [1, -1, -1, 1, 1, 1]
    parts = [F.floor(F.col("b") * (i + 1) / 7).cast("long") * s for i, s in enumerate(signs)]
    total = sum(parts[1:], parts[0]) + F.when(F.col("off"), 1).otherwise(0)
    fields = [F.struct(F.lit(i).alias("row"), F.lit(n).alias("label"), v.alias("cents")) for i, (n, v) in enumerate([*zip(labels, parts, strict=True), ("TOTAL DUE BY WED", total)])]
    rows = cust.select("doc", "page", F.explode(F.array(*fields)).alias("f")).select("doc", "page", "f.*")
    return rows.withColumn("value", F.concat(T.money(F.abs("cents")), F.when(F.col("cents") < 0, "C").otherwise("")))


@query("SELECT CAST(c_custkey AS VARCHAR) AS doc, 'invoice-total' AS code, CAST(7 AS INT) AS n_rows FROM customer WHERE c_custkey % 3 = 0")
def validate_invoice(spark, sf_dir):
    return checks.invoice_issues(invoice_fields(spark, sf_dir)).select("doc", "code", F.size("rows").alias("n_rows"))


@query("""WITH c AS (SELECT c_custkey, CAST(floor(abs(c_acctbal) * 100 + 0.5) AS BIGINT) AS b FROM customer)
, p AS (SELECT c_custkey, i AS row_no, ['FWD BALANCE', 'ON-LINE NET DUE', 'INSTANT NET DUE', 'NON-GAME ADJUSTMENTS', 'SYSTEM FEE', 'OTHER RETAILER INCENTIVES'][i + 1] AS label,
        CAST(floor(b * (i + 1) / 7) AS BIGINT) * [1, -1, -1, 1, 1, 1][i + 1] AS cents FROM c, range(6) t(i))
    SELECT CAST(c_custkey AS VARCHAR) AS doc, CAST(row_no AS BIGINT) AS row_no, label, CAST(cents AS BIGINT) AS cents FROM p
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 6, 'TOTAL DUE BY WED', CAST(sum(cents) + max(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) FROM p GROUP BY c_custkey""")
def read_weekly_invoice(spark, sf_dir):
    lines = invoice_fields(spark, sf_dir).select("doc", "page", (F.lit(100.0) + F.col("row") * 30).alias("y"), F.array("label", "value").alias("cells"))
    rows = readers.invoice(print_fields(lines, [60.0, 700.0]))
    return rows.select("doc", F.col("row").cast("long").alias("row_no"), F.element_at("cells", 1).alias("label"), T.cents(F.element_at("cells", 2)).alias("cents"))


@query("""SELECT user_id, CASE WHEN i + CASE WHEN t > 0 THEN 2 ELSE 0 END >= 3 AND i + CASE WHEN t > 0 THEN 2 ELSE 0 END >= s THEN 'inventory' WHEN s >= 3 AND s >= v THEN 'settlements' WHEN v > 0 THEN 'invoice' WHEN s > 0 THEN 'settlements' ELSE 'inventory' END AS kind
    FROM (SELECT user_id, count(*) FILTER (event_type = 'view') % 5 AS i, count(*) FILTER (event_type = 'error') % 2 AS t, count(*) FILTER (event_type = 'click') % 5 AS s, count(*) FILTER (event_type = 'purchase') % 4 AS v FROM events GROUP BY user_id)""")
def kind_choice(spark, sf_dir):
    n = lambda t, m: F.count_if(F.col("event_type") == t) % m
    c = load(spark, sf_dir, "events").groupBy("user_id").agg(n("view", 5).alias("i"), n("error", 2).alias("t"), n("click", 5).alias("s"), n("purchase", 4).alias("v"))
    return c.select("user_id", checks.choose_kind(F.col("i"), F.col("t") > 0, F.col("s"), F.col("v")).alias("kind"))


@query(f"WITH {ITEMS_SQL} SELECT doc, CAST(n // 20 + 1 AS INT) AS page, CAST(n % 20 + CASE WHEN n < 20 OR CAST(doc AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS line_id, qty || ' ' || item || ' ' || description || ' ' || price || ' ' || extended AS text, CAST(130 + 30 * (n % 20) AS DOUBLE) AS top, CAST(150 + 30 * (n % 20) AS DOUBLE) AS bottom FROM items")
def group_lines(spark, sf_dir):
    bands = geometry.line_bands(geometry.group_lines(item_words(spark, sf_dir)))
    return bands.where("top > 100").select("doc", "page", "line_id", "text", "top", "bottom")


def customer_words(spark, sf_dir):
    paged = number_pages(load(spark, sf_dir, "customer"), F.expr("cast(c_nationkey as string)"), ["c_custkey"], 20)
    return print_lines(paged.select("doc", "page", "line", F.concat_ws(" ", "c_mktsegment", F.concat(F.lit("NO"), F.col("c_custkey").cast("string"))).alias("text")))


@query("SELECT text, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([c_mktsegment, 'NO' || CAST(c_custkey AS VARCHAR)]) AS text FROM customer) GROUP BY text")
def glyph_merge(spark, sf_dir):
    words = customer_words(spark, sf_dir)
    chars = words.select("doc", "page", "word_id", "x", "y", "height", "confidence", F.posexplode(F.filter(F.split("text", ""), lambda c: c != "")).alias("i", "text"))
    boxes = chars.select("doc", "page", F.xxhash64("word_id", "i").alias("word_id"), "text", (F.col("x") + F.col("i") * 10).alias("x"), "y", F.lit(10.0).alias("width"), "height", "confidence")
    return geometry.merge_glyphs(geometry.group_lines(boxes)).groupBy("text").agg(F.count("*").alias("n"))


@query("SELECT CAST(2 * count(*) AS BIGINT) AS words FROM customer")
def overprint_dedupe(spark, sf_dir):
    words = customer_words(spark, sf_dir)
    again = words.withColumn("x", F.col("x") + 1.0).withColumn("word_id", F.xxhash64("word_id", F.lit(1)))
    return geometry.without_overprints(geometry.group_lines(words.unionByName(again))).agg(F.count("*").alias("words"))


SPANS_SQL = "spans AS (SELECT l_orderkey, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS lo, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS hi FROM lineitem)"


def spans(spark, sf_dir):
    day = F.date_diff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).cast("long")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", day.alias("lo"), (day + F.col("l_quantity").cast("long")).alias("hi"))


UNION_SQL = f"""{SPANS_SQL}, m AS (SELECT *, max(hi) OVER (PARTITION BY l_orderkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS grp FROM m),
    merged AS (SELECT l_orderkey, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY l_orderkey, grp)"""


@query(f"WITH {UNION_SQL} SELECT l_orderkey, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM merged")
def union_spans(spark, sf_dir):
    return geometry.union_spans(spans(spark, sf_dir), ["l_orderkey"]).select("l_orderkey", "lo", "hi")


@query(f"WITH {SPANS_SQL}, p AS (SELECT DISTINCT l_orderkey, lo AS spot FROM spans) SELECT l_orderkey, CAST(max(n) AS BIGINT) AS depth FROM (SELECT p.l_orderkey, spot, count(*) AS n FROM p JOIN spans s ON s.l_orderkey = p.l_orderkey AND s.lo <= spot AND s.hi > spot GROUP BY ALL) GROUP BY l_orderkey")
def coverage_sweep(spark, sf_dir):
    return geometry.coverage(spans(spark, sf_dir), ["l_orderkey"]).groupBy("l_orderkey").agg(F.max("depth").alias("depth"))


@query(f"""WITH {UNION_SQL}, gaps AS (SELECT l_orderkey, hi AS lo, lead(lo) OVER (PARTITION BY l_orderkey ORDER BY lo) AS hi FROM merged)
    SELECT l_orderkey, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY hi - lo DESC, lo DESC) AS r FROM gaps WHERE hi IS NOT NULL) WHERE r = 1""")
def widest_gutter(spark, sf_dir):
    covered = geometry.coverage(spans(spark, sf_dir), ["l_orderkey"])
    return geometry.gutters(covered, ["l_orderkey"]).where("rank = 1").select("l_orderkey", "lo", "hi")


@query("""WITH e AS (SELECT user_id, event_id, event_type, CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS at FROM events), j AS (
        SELECT i.user_id, i.event_id AS item, a.event_id AS anchor, row_number() OVER (PARTITION BY i.event_id ORDER BY abs(i.at - a.at), a.at, a.event_id) AS r
        FROM e i JOIN e a ON i.user_id = a.user_id AND a.event_type = 'click' AND i.event_type <> 'click' AND i.at - a.at BETWEEN -7200 AND 14400)
    SELECT user_id, item, anchor FROM j WHERE r = 1""")
def assign_to_anchors(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1000000).alias("at"))
    items = e.where("event_type <> 'click'").select("user_id", F.col("event_id").alias("item"), "at")
    anchors = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("anchor"), "at")
    return geometry.assign_to_anchors(items, anchors, ["user_id"], 7200.0, 14400.0).select("user_id", "item", "anchor")


@query("SELECT o_custkey, CAST(coalesce(median(gap) FILTER (gap > 4), 24) AS DOUBLE) AS pitch FROM (SELECT o_custkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gap FROM orders) GROUP BY o_custkey")
def row_pitch(spark, sf_dir):
    at = load(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("double").alias("at"))
    return geometry.row_pitch(at, ["o_custkey"], 24.0)


@query("SELECT CAST(10 AS DOUBLE) AS char_width, CAST(count(*) AS BIGINT) AS pages FROM (SELECT DISTINCT c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 20 AS page FROM customer)")
def char_width(spark, sf_dir):
    return geometry.character_width(customer_words(spark, sf_dir)).groupBy("char_width").agg(F.count("*").alias("pages"))


@query("""WITH RECURSIVE l AS (SELECT l_suppkey, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 60 AS DOUBLE) AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS line FROM lineitem),
    s AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY x) AS i, count(*) OVER (PARTITION BY l_suppkey) AS lines FROM l WHERE line <= 8),
    f AS (SELECT l_suppkey, i, 1 AS g, x AS total, 1 AS n, lines FROM s WHERE i = 1
        UNION ALL SELECT s.l_suppkey, s.i, CASE WHEN s.x - f.total / f.n <= 16 THEN f.g ELSE f.g + 1 END, CASE WHEN s.x - f.total / f.n <= 16 THEN f.total + s.x ELSE s.x END, CASE WHEN s.x - f.total / f.n <= 16 THEN f.n + 1 ELSE 1 END, s.lines
        FROM f JOIN s ON s.l_suppkey = f.l_suppkey AND s.i = f.i + 1),
    e AS (SELECT l_suppkey, g, max(n) AS n, arg_max(total, n) AS total, any_value(lines) AS lines FROM f GROUP BY l_suppkey, g)
    SELECT l_suppkey, CAST(round(total / n * 1000) AS BIGINT) AS edge, CAST(n AS BIGINT) AS n FROM e WHERE lines >= 2 AND n >= greatest(2, ceil(lines * 0.5))""")
def repeated_edges(spark, sf_dir):
    line = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber"))
    words = load(spark, sf_dir, "lineitem").select("l_suppkey", line.alias("line_id"), (F.floor("l_extendedprice").cast("long") % 60).cast("double").alias("x"), F.lit(20.0).alias("height"))
    return geometry.repeated_edges(words, ["l_suppkey"]).select("l_suppkey", F.round(F.col("edge") * 1000).cast("long").alias("edge"), "n")


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_quantity >= 35 THEN 3 WHEN l_quantity >= 20 THEN 2 WHEN l_quantity >= 10 THEN 1 ELSE 0 END AS INT) AS col FROM lineitem")
def column_index(spark, sf_dir):
    bounds = F.array(*map(F.lit, (0.0, 10.0, 20.0, 35.0)))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.column_index(F.col("l_quantity"), bounds).cast("int").alias("col"))


LINES_SQL = "lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)"


def text_lines(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line"))


@query(f"WITH {LINES_SQL} SELECT doc_id, regexp_replace(lower(line), '[^a-z0-9]+', '', 'g') AS flat, CAST(count(*) AS BIGINT) AS n FROM lines GROUP BY ALL")
def normalise_text(spark, sf_dir):
    return text_lines(spark, sf_dir).groupBy("doc_id", T.flat(F.col("line")).alias("flat")).agg(F.count("*").alias("n"))


@query(f"""WITH {LINES_SQL} SELECT source, CAST(count(*) FILTER (regexp_matches(line, '(?i)\\bout\\s*of\\s*stock\\b|\\bno\\s*stock\\b')) AS BIGINT) AS stock_notes,
    CAST(count(*) FILTER (regexp_matches(regexp_replace(line, '\\s', '', 'g'), '^[-_=.*]{{4,}}$')) AS BIGINT) AS rules, CAST(count(*) FILTER (regexp_matches(line, '^\\*+[^*]+\\*+$|^\\*+\\s')) AS BIGINT) AS starred,
    CAST(count(*) FILTER (regexp_matches(line, '[A-Za-z0-9]')) AS BIGINT) AS inked, CAST(count(*) FILTER (len(regexp_extract_all(line, '[A-Za-z][A-Za-z.\\s]*:\\s*\\$?-?[0-9,]+(?:\\.[0-9]+)?')) >= 2) AS BIGINT) AS totals FROM lines GROUP BY source""")
def line_marks(spark, sf_dir):
    c = F.col("line")
    return text_lines(spark, sf_dir).groupBy("source").agg(
        F.sum(F.size(T.stock_notes(c)).cast("boolean").cast("long")).alias("stock_notes"), F.count_if(T.is_rule(c)).alias("rules"), F.count_if(T.is_starred(c)).alias("starred"), F.count_if(T.is_inked(c)).alias("inked"), F.count_if(T.is_document_total(c)).alias("totals")
    )


@query(f"WITH {LINES_SQL}, t AS (SELECT source, line, doc_id FROM lines WHERE line <> '') SELECT source, line, CAST(count(DISTINCT doc_id) AS BIGINT) AS pages, CAST(count(*) AS BIGINT) AS times FROM t GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2")
def repeated_lines(spark, sf_dir):
    per_page = text_lines(spark, sf_dir).where("line <> ''").groupBy("source", "line", "doc_id").agg(F.count("*").alias("k"))
    return per_page.groupBy("source", "line").agg(F.count("*").alias("pages"), F.sum("k").alias("times")).where("pages >= 2")


def event_lines(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("doc"), (F.col("event_id") % 4 + 1).cast("int").alias("page"), F.lit("unplaced").alias("reason"), F.concat_ws(" ", "event_type", (F.col("event_id") % 50).cast("string")).alias("text"), F.lit(1.0).alias("confidence"), F.lit(0.0).alias("y"), (F.col("value") % 40).alias("x"))


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS doc, event_id % 4 + 1 AS page, upper(event_type || ' ' || CAST(event_id % 50 AS VARCHAR)) AS norm, value % 40 AS x FROM events),
    rep AS (SELECT doc, norm FROM e GROUP BY doc, norm HAVING count(DISTINCT page) >= 2), m AS (SELECT e.*, rep.norm IS NOT NULL AS again FROM e LEFT JOIN rep USING (doc, norm)),
    ind AS (SELECT doc, min(i) AS indent FROM (SELECT doc, floor(x) AS i FROM m WHERE NOT again AND x > 10 GROUP BY doc, floor(x) HAVING count(*) >= 2) GROUP BY doc)
    SELECT m.doc, CASE WHEN again THEN 'page-field' WHEN x < 10 THEN 'margin' WHEN x >= indent THEN 'annotation' ELSE 'unplaced' END AS reason, CAST(count(*) AS BIGINT) AS n FROM m LEFT JOIN ind USING (doc) GROUP BY ALL""")
def refine_skipped(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    lefts = lines.select("doc", "page").distinct().withColumn("body_left", F.lit(10.0))
    return skips.refine(lines, lefts).groupBy("doc", "reason").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT CAST(user_id AS VARCHAR) AS doc, event_id % 4 + 1 AS page, ['unplaced', 'annotation', 'note', 'summary', 'furniture', 'nonsense'][event_id % 6 + 1] AS reason, event_type AS text FROM events)
    SELECT doc, reason, text, CAST(count(*) AS BIGINT) AS times, CAST(count(DISTINCT page) AS BIGINT) AS pages, reason = 'unplaced' AS needs_check FROM r WHERE reason <> 'nonsense' GROUP BY ALL""")
def skip_groups(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    names = F.array(*map(F.lit, ("unplaced", "annotation", "note", "summary", "furniture", "nonsense")))
    rows = e.select(F.col("user_id").cast("string").alias("doc"), (F.col("event_id") % 4 + 1).cast("int").alias("page"), F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("reason"), F.col("event_type").alias("text"), F.lit(0.5).alias("confidence"))
    return skips.log_groups(rows).select("doc", "reason", "text", "times", F.size("pages").cast("long").alias("pages"), F.col("check").alias("needs_check"))


@query("SELECT CAST(user_id AS VARCHAR) AS doc, CAST(count(DISTINCT event_type) AS BIGINT) AS lines, CAST(count(*) AS BIGINT) AS times FROM events WHERE event_id % 3 = 0 GROUP BY user_id")
def needs_checking(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("doc"), (F.col("event_id") % 4 + 1).cast("int").alias("page"), F.when(F.col("event_id") % 3 == 0, "unplaced").otherwise("note").alias("reason"), F.col("event_type").alias("text"), F.lit(0.5).alias("confidence"))
    return skips.needs_checking(skips.log_groups(rows))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents FROM orders")
def money_to_cents(spark, sf_dir):
    shown = F.concat(F.lit("$"), decimal_text("o_totalprice"), F.when(F.col("o_orderkey") % 2 == 0, "C").otherwise(""))
    return load(spark, sf_dir, "orders").select("o_orderkey", T.cents(shown).alias("cents"))


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || CASE WHEN o_orderkey % 3 = 0 THEN 'C' ELSE '' END AS amount FROM orders")
def invoice_amount(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    shown = F.concat(F.lit("“"), decimal_text("o_totalprice"), F.when(F.col("o_orderkey") % 3 == 0, "¢").otherwise(""), F.lit("|"))
    return orders.select("o_orderkey", T.invoice_amount(shown).alias("amount"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%y') AS settled FROM orders")
def settled_date(spark, sf_dir):
    form = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MM/dd/yy")).otherwise(F.date_format("o_orderdate", "MM.dd-yy"))
    return load(spark, sf_dir, "orders").select("o_orderkey", T.settled_date(F.concat(form, F.lit(";"))).alias("settled"))


@query("SELECT p_partkey, '$' || CAST(p_partkey % 900 + 100 AS VARCHAR) || ',000' || upper(p_name) AS name FROM part")
def repair_money(spark, sf_dir):
    token = F.concat(F.lit("S"), (F.col("p_partkey") % 900 + 100).cast("string"), F.lit(".OOO"))
    return load(spark, sf_dir, "part").select("p_partkey", F.concat(T.repair_game_name(token), F.upper("p_name")).alias("name"))


@query("SELECT o_orderkey, lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS pack FROM orders")
def pack_token(spark, sf_dir):
    digits = F.concat(F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    damaged = F.concat(F.translate(F.substring(digits, 1, 2), "058", "OSB"), F.substring(digits, 3, 20), F.lit(":"))
    return load(spark, sf_dir, "orders").select("o_orderkey", T.pack_token(damaged).alias("pack"))


@query("SELECT o_orderkey, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS digits FROM orders")
def count_digits(spark, sf_dir):
    three = F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0")
    damaged = F.concat(F.translate(F.substring(three, 1, 1), "01", "Ol"), F.substring(three, 2, 2))
    return load(spark, sf_dir, "orders").select("o_orderkey", T.count_digits(damaged).alias("digits"))


@query("""SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS cell, TRUE AS quantity, TRUE AS figure, l_tax > 0.04 AS item, TRUE AS starred, FALSE AS worded FROM lineitem""")
def line_item_predicates(spark, sf_dir):
    q, price = F.col("l_quantity").cast("long").cast("string"), F.when(F.col("l_tax") > 0.04, decimal_text("l_extendedprice")).otherwise("note only")
    cells = F.array(q, F.lit("plain words"), price)
    starred = F.array(F.concat(F.lit("*"), F.lpad(F.col("l_partkey").cast("string"), 6, "0")), F.lit("WIDGET"), decimal_text("l_extendedprice"))
    worded = F.array(q, F.concat(F.lit("SUB TOTAL "), decimal_text("l_extendedprice")))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.is_line_item(starred).alias("starred"), T.is_line_item(worded).alias("worded"), q.alias("cell"), T.is_quantity(q).alias("quantity"), T.is_figure(q).alias("figure"), T.is_line_item(cells).alias("item"))


@query("SELECT p_partkey, regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g') AS slug FROM part")
def slugify(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", T.slugify(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"))


@query("""WITH p AS (SELECT DISTINCT user_id, event_id % 30 AS page FROM events), g AS (SELECT *, page - row_number() OVER (PARTITION BY user_id ORDER BY page) AS g FROM p),
    r AS (SELECT user_id, min(page) AS a, max(page) AS b FROM g GROUP BY user_id, g)
    SELECT user_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) END, ', ' ORDER BY a) AS pages FROM r GROUP BY user_id""")
def page_ranges(spark, sf_dir):
    pages = load(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_set((F.col("event_id") % 30).cast("int"))).alias("p"))
    return pages.select("user_id", T.page_range(F.col("p")).alias("pages"))


def order_pages(spark, sf_dir):
    """Export pages of ten orders; even pages have another order of titles and a title twice."""
    paged = number_pages(load(spark, sf_dir, "orders"), F.expr("cast(o_custkey as string)"), ["o_orderkey"], 10)
    key, price = F.col("o_orderkey").cast("string"), decimal_text("o_totalprice")
    cells = F.when(F.col("page") % 2 == 1, F.array(key, F.col("o_orderstatus"), price)).otherwise(F.array(F.col("o_orderstatus"), key, price, price))
    heads = F.when(F.col("page") % 2 == 1, F.array(*map(F.lit, ("KEY", "STATUS", "PRICE")))).otherwise(F.array(*map(F.lit, ("STATUS", "KEY", "PRICE", "PRICE"))))
    rows = paged.select("doc", "page", "line", cells.alias("c"), heads.alias("headers"))
    grouped = rows.groupBy("doc", "page", "headers").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "c"))), lambda s: s["c"]).alias("rows"))
    return grouped.withColumn("kind", F.when(F.col("page") % 2 == 1, "table").otherwise("invoice"))


ORDER_PAGES_SQL = "o AS (SELECT CAST(o_custkey AS VARCHAR) AS doc, o_orderkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders), d AS (SELECT doc, max(n // 10 + 1) AS pages FROM o GROUP BY doc)"


@query(f"WITH {ORDER_PAGES_SQL} SELECT doc, CAST(i AS INT) AS ord, ['KEY', 'STATUS', 'PRICE', 'PRICE (2)'][i + 1] AS column_key FROM d, range(4) t(i) WHERE i < 3 OR pages > 1")
def document_layout(spark, sf_dir):
    return export.document_layout(order_pages(spark, sf_dir)).select("doc", F.col("ord").cast("int").alias("ord"), F.col("key").alias("column_key"))


@query(f"WITH {ORDER_PAGES_SQL} SELECT doc, CAST(n // 10 + 1 AS INT) AS page, CAST(n % 10 AS INT) AS row_no, CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus || '|' || price || CASE WHEN pages = 1 THEN '' WHEN (n // 10) % 2 = 1 THEN '|' || price ELSE '|' END AS cells FROM o JOIN d USING (doc)")
def export_rows(spark, sf_dir):
    return export.export_rows(order_pages(spark, sf_dir)).select("doc", "page", F.col("row").alias("row_no"), F.array_join("cells", "|").alias("cells"))


@query(f"""WITH {ORDER_PAGES_SQL}, l AS (SELECT doc, n, pages, CASE WHEN pages > 1 THEN CAST(n // 10 + 1 AS VARCHAR) || ',' ELSE '' END || CAST(o_orderkey AS VARCHAR) || ',' || o_orderstatus || ',' || price || CASE WHEN pages = 1 THEN '' WHEN (n // 10) % 2 = 1 THEN ',' || price ELSE ',' END AS line FROM o JOIN d USING (doc))
    SELECT doc, CASE WHEN pages > 1 THEN 'Page,KEY,STATUS,PRICE,PRICE' ELSE 'KEY,STATUS,PRICE' END || chr(13) || chr(10) || string_agg(line, chr(13) || chr(10) ORDER BY n) AS csv FROM l GROUP BY doc, pages""")
def document_csv(spark, sf_dir):
    pages = order_pages(spark, sf_dir)
    return export.document_csv(pages, pages.groupBy("doc").agg(F.max("page").alias("total")))


@query(f"""WITH {ORDER_PAGES_SQL} SELECT doc, CAST(n // 10 + 1 AS INT) AS page, CAST(n % 10 AS INT) AS row_no, '{{"KEY":"' || CAST(o_orderkey AS VARCHAR) || '","STATUS":"' || o_orderstatus || '","PRICE":"' || price || CASE WHEN (n // 10) % 2 = 1 THEN '","PRICE (2)":"' || price ELSE '' END || '"}}' AS json FROM o""")
def document_json_rows(spark, sf_dir):
    return export.row_json(order_pages(spark, sf_dir)).select("doc", "page", F.col("row").alias("row_no"), "json")


@query(f"WITH {ORDER_PAGES_SQL} SELECT doc, CASE WHEN pages > 1 THEN 'mixed' ELSE 'table' END AS kind FROM d")  # a blank page of another kind stands before each document's own
def document_kinds(spark, sf_dir):
    pages = order_pages(spark, sf_dir)
    blank = pages.where("page = 1").withColumn("page", F.lit(0).cast(pages.schema["page"].dataType)).withColumn("kind", F.lit("settlements")).withColumn("rows", F.slice("rows", 1, 0))
    return export.document_kinds(pages.unionByName(blank))


@query(f"WITH {ORDER_PAGES_SQL} SELECT doc, CAST(p AS INT) AS page FROM d, range(1, 100) t(p) WHERE p <= pages + 2 AND p % 2 = 0")
def missing_pages(spark, sf_dir):
    pages = order_pages(spark, sf_dir)
    totals = pages.groupBy("doc").agg((F.max("page") + 2).alias("total"))
    read = pages.select("doc", "page").where("page % 2 = 1").unionByName(totals.select("doc", F.explode(F.sequence(F.lit(1), F.col("total"))).alias("page")).where("page % 2 = 1"))
    return export.missing_pages(read, totals)


@query("SELECT 'd' AS doc, 'Nations' AS title, 'nations' AS slug, CAST(count(*) AS BIGINT) AS n FROM nation UNION ALL SELECT 'd', 'r_name', 'r-name', count(*) FROM region")
def extra_tables(spark, sf_dir):
    nations = load(spark, sf_dir, "nation").groupBy((F.col("n_regionkey") + 1).alias("page")).agg(F.collect_list(F.array("n_name")).alias("rows")).select(F.lit("d").alias("doc"), "page", F.lit(0).alias("pos"), F.lit("Nations").alias("title"), F.array(F.lit("n_name")).alias("headers"), "rows")
    regions = load(spark, sf_dir, "region").select(F.lit("d").alias("doc"), (F.col("r_regionkey") + 1).alias("page"), F.lit(1).alias("pos"), F.lit("").alias("title"), F.array(F.lit("r_name")).alias("headers"), F.array(F.array("r_name")).alias("rows"))
    gone = nations.select("doc", F.lit("none").alias("key")).distinct()
    return export.extra_tables(nations.unionByName(regions), gone).select("doc", "title", "slug", F.size("rows").cast("long").alias("n"))


def review_rows(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("doc"), F.lit(1).alias("page"), F.col("o_orderkey").alias("row"), F.lit("invoice").alias("kind"), F.array(F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderpriority")), F.col("o_orderstatus")).alias("cells"), ((F.col("o_orderkey") % 100) / 100).alias("confidence"), F.lit(False).alias("label"))


REVIEW_SQL = "s AS (SELECT o_custkey, o_orderkey, (o_orderkey % 11 = 0 OR (o_orderkey % 100) / 100.0 < 0.55 OR o_orderkey % 7 = 0) AND o_orderkey % 5 <> 0 AS review FROM orders)"


def _status(spark, sf_dir):
    rows = review_rows(spark, sf_dir)
    accepted = rows.where("row % 5 = 0").select("doc", "page", "row")
    issues = rows.where("row % 11 = 0").select("doc", "page", F.lit("invoice-total").alias("code"), F.array("row").alias("rows"))
    return review.row_status(rows, accepted, issues)


@query(f"WITH {REVIEW_SQL} SELECT CAST(o_custkey AS VARCHAR) AS doc, o_orderkey AS row_no, review FROM s")
def row_status(spark, sf_dir):
    return _status(spark, sf_dir).select("doc", F.col("row").alias("row_no"), "review")


@query(f"WITH {REVIEW_SQL} SELECT CAST(o_custkey AS VARCHAR) AS doc, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (NOT review) AS BIGINT) AS valid FROM s GROUP BY o_custkey")
def valid_counts(spark, sf_dir):
    return review.valid_counts(_status(spark, sf_dir))


@query("SELECT CAST(o_custkey AS VARCHAR) AS doc, o_orderkey AS row_no FROM orders WHERE o_orderkey % 7 <> 0 AND contains(lower(o_orderpriority), 'urgent')")
def search_rows(spark, sf_dir):
    return review.search(review_rows(spark, sf_dir), "URGENT").select("doc", F.col("row").alias("row_no"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS doc, o_orderkey AS row_no FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 12")
def first_rows(spark, sf_dir):
    return review.first_rows(review_rows(spark, sf_dir)).select("doc", F.col("row").alias("row_no"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS doc, o_orderkey AS row_no, CASE WHEN o_orderkey % 4 = 0 THEN 'second' ELSE o_orderstatus END AS status, o_orderkey % 4 = 0 AS edited FROM orders")
def apply_edits(spark, sf_dir):
    rows = review_rows(spark, sf_dir)
    edits = rows.where("row % 4 = 0").select("doc", "page", "row", F.lit(1).alias("cell"), F.explode(F.array(F.struct(F.lit("first").alias("value"), F.lit(1).alias("seq")), F.struct(F.lit("second").alias("value"), F.lit(2).alias("seq")))).alias("e")).select("doc", "page", "row", "cell", "e.*")
    return review.apply_edits(rows, edits).select("doc", F.col("row").alias("row_no"), F.element_at("cells", 2).alias("status"), "edited")


@query("""WITH t AS (SELECT o_custkey, o_orderkey, 5 + o_orderkey % 4 AS d FROM orders), c AS (SELECT o_custkey, d, count(*) AS n, min(o_orderkey) AS f FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) AS r FROM c)
    SELECT o_custkey, CAST(d AS INT) AS digits FROM r WHERE r = 1 AND n >= 3""")
def modal_pack_digits(spark, sf_dir):
    code = F.concat(F.lit("123-"), F.lpad(F.col("o_orderkey").cast("string"), (5 + F.col("o_orderkey") % 4).cast("int"), F.lit("0")))
    tokens = load(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), code.alias("text"))
    return recogniser.modal_pack_digits(tokens, ["o_custkey"]).select("o_custkey", F.col("digits").cast("int").alias("digits"))


@query("SELECT o_orderkey, '123-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS pack, '20X GAME' AS rest, strftime(o_orderdate, '%m/%d/%y') AS settled FROM orders")
def cut_glued_tokens(spark, sf_dir):
    token = F.concat(F.lit("123-"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), F.lit("20X GAME"), F.date_format("o_orderdate", "MM/dd/yy"))
    pieces = recogniser.structural_cuts(token, F.lit(6))
    return load(spark, sf_dir, "orders").select("o_orderkey", pieces[0].alias("pack"), pieces[1].alias("rest"), pieces[2].alias("settled"))


@query("SELECT p_partkey, p_name AS name, translate(p_name, 'oi', '01') AS kept FROM part")
def vote_characters(spark, sf_dir):
    damaged = F.translate(F.col("p_name"), "oi", "01")
    wide = F.translate(F.col("p_name"), "ae", "ａｅ")
    read = load(spark, sf_dir, "part").withColumn("readings", recogniser.compatible(F.array("p_name", wide, F.regexp_replace("p_name", " ", ""))))
    return read.select("p_partkey", recogniser.vote_characters(damaged, F.col("readings")).alias("name"), recogniser.vote_characters(damaged, F.array("p_name", F.lit("short"))).alias("kept"))


@query()
def ink_gaps(spark, sf_dir):
    """Pages of two blocks of ink, drawn as bytes, one wider apart than the other; the gaps come back."""
    row = F.concat(F.repeat(F.lit("\x00"), 6), F.repeat(F.lit("\xff"), (F.col("r_regionkey") + 4).cast("int")), F.repeat(F.lit("\x00"), 6))
    page = F.encode(F.repeat(row, 10), "ISO-8859-1")
    gaps = recogniser.ink_gaps_of(page, (F.col("r_regionkey") + 16).cast("int"), F.lit(10))
    return load(spark, sf_dir, "region").select("r_regionkey", gaps[0]["start"].alias("start"), gaps[0]["end"].alias("end"))


WRAP_SQL = "o AS (SELECT CAST(o_custkey AS VARCHAR) AS doc, o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)"


@query(f"""WITH {WRAP_SQL} SELECT doc, CAST(n // 10 + 1 AS INT) AS page, CAST(n % 10 AS BIGINT) AS row_no, 'ORD' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS item,
    'FINE GOODS' || CASE WHEN o_orderkey % 2 = 0 THEN ' MADE TO LAST' ELSE '' END || CASE WHEN o_orderkey % 4 = 0 THEN ' AND MORE' ELSE '' END AS description FROM o""")
def read_wrapped_rows(spark, sf_dir):
    """Descriptions that run on over one or two more lines come back in one cell."""
    paged = number_pages(load(spark, sf_dir, "orders"), F.expr("cast(o_custkey as string)"), ["o_orderkey"], 10)
    blank = F.lit("")
    first = paged.select("doc", "page", (F.col("line") * 3).alias("line"), F.array(F.lit("1"), F.concat(F.lit("ORD"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")), F.lit("FINE GOODS"), decimal_text("o_totalprice")).alias("cells"))
    second = paged.where("o_orderkey % 2 = 0").select("doc", "page", (F.col("line") * 3 + 1).alias("line"), F.array(blank, blank, F.lit("MADE TO LAST"), blank).alias("cells"))
    third = paged.where("o_orderkey % 4 = 0").select("doc", "page", (F.col("line") * 3 + 2).alias("line"), F.array(blank, blank, F.lit("AND MORE"), blank).alias("cells"))
    words = print_table(first.unionByName(second).unionByName(third), ["QTY", "ITEM#", "DESCRIPTION", "PRICE"], [60.0, 200.0, 400.0, 900.0], F.lit(True))
    rows = tables.wrapped_rows(tables.read_lines(words))
    return rows.select("doc", "page", F.col("row").cast("long").alias("row_no"), F.element_at("cells", 2).alias("item"), F.element_at("cells", 3).alias("description"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS doc, 'WEEKLY INVOICE' AS title, TRUE AS weekly FROM customer")
def page_titles(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    texts = [F.lit("www.example.com"), F.concat(F.lit("WEEKLY INVOICE OF "), F.col("c_mktsegment")), F.lit("01/02/24 printed"), F.lit("Fwd Balance 12.00"), F.lit("System Fee 1.00"), F.lit("QTY PRICE AMOUNT")]
    lines = c.select(F.col("c_custkey").cast("string").alias("doc"), F.lit(1).alias("page"), F.posexplode(F.array(*texts)).alias("line", "text"))
    words = print_lines(lines)
    weekly = tables.weekly_invoices(words).withColumn("weekly", F.lit(True))
    return tables.page_titles(words).join(weekly, ["doc", "page"], "left").select("doc", "title", F.coalesce("weekly", F.lit(False)).alias("weekly"))


@query("SELECT doc_id AS doc, CAST(1 AS INT) AS page FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE trim(w) <> '' GROUP BY doc_id HAVING count(*) >= 8 AND sum(length(regexp_replace(w, '[^\\p{L}\\p{N}]', '', 'g'))) >= 40")
def usable_text_layers(spark, sf_dir):
    """Pages of a text layer with enough words to be read without a recogniser."""
    from tablewright.sources.pages import usable_pages

    words = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), F.explode(F.split("text", " ")).alias("text")).where(F.trim("text") != "")
    return usable_pages(words)


@query("SELECT CAST(o_custkey AS VARCHAR) AS doc, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY o_custkey")
def posted_pages(spark, sf_dir):
    """Pages posted as JSON come back as export pages."""
    from tablewright.sources.pages import posted_pages as parse

    page = order_pages(spark, sf_dir)
    rows = F.transform("rows", lambda r: F.struct(r.alias("cells"), F.lit(1.0).alias("confidence")))
    posts = page.select("doc", F.to_json(F.struct("page", "kind", "headers", rows.alias("rows"))).alias("body"))
    cells = parse(posts).select("doc", "page", F.explode("rows").alias("cells"))
    key = F.when(F.col("page") % 2 == 1, F.col("cells")[0]).otherwise(F.col("cells")[1])
    return cells.groupBy("doc").agg(F.count("*").alias("n"), F.sum(key.cast("long")).alias("keys"))


GLUED_SQL = "w AS (SELECT l_orderkey, l_linenumber, [lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0'), lpad(CAST(l_suppkey % 1000 AS VARCHAR), 3, '0'), lpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 3, '0'), '007'][1:l_linenumber % 3 + 2] AS counts FROM lineitem)"


def glued_words(spark, sf_dir):
    """Words of two to four glued counts, one a line item; some glued by dots."""
    three = lambda c: F.lpad(c.cast("long").cast("string"), 3, "0")
    counts = F.slice(F.array(three(F.col("l_partkey") % 1000), three(F.col("l_suppkey") % 1000), three(F.col("l_quantity")), F.lit("007")), 1, F.col("l_linenumber") % 3 + 2)
    glue = F.when(F.col("l_orderkey") % 2 == 0, F.array_join(counts, "")).otherwise(F.array_join(counts, "."))
    items = load(spark, sf_dir, "lineitem").repartition("l_orderkey")  # a few row groups are few tasks, the cuts are work for many
    return items.select(
        F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.col("l_linenumber").cast("long").alias("line_id"), F.xxhash64("l_orderkey", "l_linenumber").alias("word_id"), glue.alias("text"),
        F.lit(100.0).alias("x"), (F.col("l_linenumber") * 30.0).alias("y"), F.lit(120.0).alias("width"), F.lit(20.0).alias("height"), F.lit(1.0).alias("confidence"),
    )


@query(f"WITH {GLUED_SQL} SELECT l_orderkey AS doc, CAST(l_linenumber AS BIGINT) AS line_id, counts[i] AS count_text, CAST(100 + 120.0 / len(counts) * (i - 1) AS DOUBLE) AS x FROM w, range(1, 5) t(i) WHERE i <= len(counts)")
def split_counts(spark, sf_dir):
    words = finding.split_counts(glued_words(spark, sf_dir))
    return words.select("doc", "line_id", F.col("text").alias("count_text"), "x")


@query("SELECT o_orderkey AS doc, lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || ' ' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || ' 040 007' AS counts FROM orders")
def tight_counts(spark, sf_dir):
    """Four glued counts lie closer than any run with the number that stands apart from them."""
    three = lambda c: F.lpad((F.col(c) % 1000).cast("string"), 3, "0")
    glued = F.struct(F.concat(three("o_custkey"), three("o_orderkey"), F.lit("040007")).alias("text"), F.lit(100.0).alias("x"), F.lit(120.0).alias("width"))
    apart = F.struct(F.lit("12").alias("text"), F.lit(20.0).alias("x"), F.lit(20.0).alias("width"))
    placed = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(1).alias("page"), F.lit(0).alias("line_id"), F.posexplode(F.array(apart, glued)).alias("word_id", "w"))
    words = placed.select("doc", "page", "line_id", F.col("word_id").cast("long").alias("word_id"), "w.*")
    return finding.tight_counts(words).select("doc", F.array_join("counts", " ").alias("counts"))


@query("SELECT o_orderkey, lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS pack, CAST(CASE WHEN o_orderkey % 3 = 2 THEN 2 ELSE 1 END AS INT) AS halves FROM orders")
def find_packs(spark, sf_dir):
    """Pack codes printed with a hyphen, without, and in two words."""
    game, number = F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")
    form = F.element_at(F.array(F.array(F.concat_ws("-", game, number)), F.array(F.concat(game, number)), F.array(game, number)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    cells = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(1).alias("page"), F.lit(0).alias("line_id"), F.posexplode(F.concat(form, F.array(F.lit("NAME")))).alias("i", "text"))
    words = cells.select("doc", "page", "line_id", F.xxhash64("doc", "i").alias("word_id"), "text", (F.col("i") * 50.0).alias("x"), F.lit(0.0).alias("y"), F.lit(40.0).alias("width"), F.lit(20.0).alias("height"))
    return finding.line_packs(words).select(F.col("doc").alias("o_orderkey"), "pack", "halves")


@query("""WITH d AS (SELECT o_custkey // 8 AS doc, o_orderkey, o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey // 8 ORDER BY o_orderkey) - 1 AS n FROM orders)
    SELECT CAST(doc AS VARCHAR) AS doc, CAST(n // 25 + 1 AS INT) AS page, CAST(n % 25 AS BIGINT) AS row_no, CASE WHEN n % 25 % 6 = 4 THEN '' ELSE lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') END AS pack,
        'GAME ' || CAST(o_custkey AS VARCHAR) AS name, strftime(o_orderdate, '%m/%d/%y') AS settled FROM d""")
def read_lone_dates(spark, sf_dir):
    """Settlements of which every sixth has no readable pack code keep their row by their date."""
    paged = number_pages(load(spark, sf_dir, "orders"), F.expr("cast(o_custkey div 8 as string)"), ["o_orderkey"], 25)
    pack = F.when(F.col("line") % 6 == 4, "").otherwise(F.concat(F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")))
    cells = F.array(pack, F.concat(F.lit("GAME "), F.col("o_custkey").cast("string")), F.date_format("o_orderdate", "MM/dd/yy"))
    words = print_table(paged.select("doc", "page", "line", cells.alias("cells")), ["Game-Pack", "Name", "Date Settled"], [60.0, 300.0, 900.0], F.lit(True))
    rows = readers.settlements(words)
    return rows.select("doc", "page", F.col("row").cast("long").alias("row_no"), *named(rows, "pack", "name", "settled"))


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS doc, CAST((n // 10) + 1 AS INT) AS page, 'ORDERS OF ' || CAST(o_custkey AS VARCHAR) AS heading FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)")
def table_headings(spark, sf_dir):
    paged = number_pages(load(spark, sf_dir, "orders"), F.expr("cast(o_custkey as string)"), ["o_orderkey"], 10)
    rows = paged.select("doc", "page", "line", F.array(F.lit("1"), F.concat(F.lit("ORD"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")), decimal_text("o_totalprice")).alias("cells"))
    body = print_table(rows, ["QTY", "ITEM#", "PRICE"], [60.0, 200.0, 900.0], F.lit(True))
    heads = paged.select("doc", "page").distinct()
    above = print_lines(heads.select("doc", "page", F.lit(-1).alias("line"), F.concat(F.lit("ORDERS OF "), F.col("doc")).alias("text")))
    priced = print_lines(heads.select("doc", "page", F.lit(-2).alias("line"), F.lit("BALANCE 12.00").alias("text")))
    return finding.table_headings(body.unionByName(above).unionByName(priced))


@query(f"""WITH {ORDER_PAGES_SQL}, r AS (SELECT doc, n, pages, '{{' || CASE WHEN pages > 1 THEN '"page":' || CAST(n // 10 + 1 AS VARCHAR) || ',' ELSE '' END || '"KEY":"' || CAST(o_orderkey AS VARCHAR) || '","STATUS":"' || o_orderstatus || '","PRICE":"' || price || CASE WHEN pages = 1 THEN '' ELSE '","PRICE (2)":"' || CASE WHEN (n // 10) % 2 = 1 THEN price ELSE '' END END || '"}}' AS row FROM o JOIN d USING (doc))
    SELECT doc, '{{"kind":"' || CASE WHEN pages > 1 THEN 'mixed","title":"Orders","pages":' || CAST(pages + 1 AS VARCHAR) || ',"missingPages":[' || CAST(pages + 1 AS VARCHAR) || '],"headers":["KEY","STATUS","PRICE","PRICE (2)"]' ELSE 'table","title":"Orders","headers":["KEY","STATUS","PRICE"]' END || ',"rows":[' || string_agg(row, ',' ORDER BY n) || '],"tables":[{{"title":"Sum","headers":["N"],"rows":[{{' || CASE WHEN pages > 1 THEN '"page":1,' ELSE '' END || '"N":"' || CAST(count(*) AS VARCHAR) || '"}}]}}]}}' AS json FROM r GROUP BY doc, pages""")
def document_json(spark, sf_dir):
    """Documents with a title, a page that was not read where they have several, and an extra table."""
    pages = order_pages(spark, sf_dir).withColumn("title", F.when(F.col("page") == 1, "Orders"))
    totals = pages.groupBy("doc").agg(F.max("page").alias("last")).select("doc", F.when(F.col("last") > 1, F.col("last") + 1).otherwise(1).alias("total"))
    sums = pages.groupBy("doc").agg(F.sum(F.size("rows")).cast("string").alias("n")).select("doc", F.lit(1).alias("page"), F.lit(0).alias("pos"), F.lit("Sum").alias("title"), F.array(F.lit("N")).alias("headers"), F.array(F.array("n")).alias("rows"))
    return export.document_json(pages, totals, export.extra_tables(sums))


def nation_tables(spark, sf_dir):
    """Extra tables: a region's nations on its page; the first page has a page of its own printed as Page."""
    rows = F.transform(F.sort_array(F.collect_list("n_name")), lambda n: F.array(n, F.upper(n)))
    nations = load(spark, sf_dir, "nation").groupBy((F.col("n_regionkey") + 1).cast("int").alias("page")).agg(rows.alias("rows"))
    tables_ = nations.select(F.lit("d").alias("doc"), "page", F.lit(0).alias("pos"), F.lit("Nations").alias("title"), F.array(F.lit("NATION"), F.lit("Page")).alias("headers"), "rows")
    return export.extra_tables(tables_), tables_.groupBy("doc").agg(F.max("page").alias("total"))


@query("SELECT 'd' AS doc, 'PDF Page,NATION,Page' || chr(13) || chr(10) || string_agg(CAST(n_regionkey + 1 AS VARCHAR) || ',' || n_name || ',' || upper(n_name), chr(13) || chr(10) ORDER BY n_regionkey, n_name) AS csv FROM nation")
def extra_table_csv(spark, sf_dir):
    return export.table_csv(*nation_tables(spark, sf_dir)).select("doc", "csv")


@query("""SELECT 'd' AS doc, '{"title":"Nations","headers":["NATION","Page"],"rows":[' || string_agg('{"page":' || CAST(n_regionkey + 1 AS VARCHAR) || ',"NATION":"' || n_name || '","Page":"' || upper(n_name) || '"}', ',' ORDER BY n_regionkey, n_name) || ']}' AS json FROM nation""")
def extra_table_json(spark, sf_dir):
    return export.table_json(*nation_tables(spark, sf_dir)).select("doc", "json")


@query("""WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, (min(c_custkey % 3) = 0) AS first, bool_or(c_custkey % 3 = 1) AS second, bool_or(c_custkey % 3 = 2) AS third FROM customer GROUP BY ALL),
    l AS (SELECT c_nationkey, c_mktsegment, 'yes,Not placed in a column,' || CASE WHEN first AND second AND third THEN '1-3' WHEN first AND second THEN '1-2' WHEN second AND third THEN '2-3' WHEN first AND third THEN '1, 3' WHEN first THEN '1' WHEN second THEN '2' ELSE '3' END AS a, n,
        [x for x in [CASE WHEN first THEN 1 END, CASE WHEN second THEN 2 END, CASE WHEN third THEN 3 END] if x IS NOT NULL] AS pages FROM g)
    SELECT CAST(c_nationkey AS VARCHAR) AS doc, 'Check,Kind,Pages,Times,Printed text,Confidence' || chr(13) || chr(10) || string_agg(CASE WHEN contains(a, ', ') THEN replace(a, '1, 3', '"1, 3"') ELSE a END || ',' || CAST(n AS VARCHAR) || ',' || c_mktsegment || ',0.50', chr(13) || chr(10) ORDER BY pages, c_mktsegment) AS csv FROM l GROUP BY c_nationkey""")
def skip_log_csv(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    rows = c.select(F.col("c_nationkey").cast("string").alias("doc"), (F.col("c_custkey") % 3 + 1).cast("int").alias("page"), F.lit("unplaced").alias("reason"), F.col("c_mktsegment").alias("text"), F.lit(0.5).alias("confidence"))
    return skips.log_csv(skips.log_groups(rows))


@query("""SELECT n_nationkey, CAST(CASE n_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 1 END AS INT) AS wide, CASE n_nationkey % 4 WHEN 0 THEN 'true false true' WHEN 1 THEN 'false true true' ELSE 'true false true' END AS figures,
    CASE WHEN n_regionkey = 0 THEN n_name ELSE ['Invoice', 'Invoice Breakdown', 'Pack Settlements', 'Inventory Summary'][n_nationkey % 4 + 1] END AS title, n_name || '.part' AS file FROM nation""")
def shown_columns(spark, sf_dir):
    """Which column is wide, which hold figures, and what a reading and its file are called."""
    kind = F.element_at(F.array(*map(F.lit, ("table", "invoice", "settlements", "inventory"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    heads = F.array(F.lit("QTY"), F.concat(F.lit("Product "), F.col("n_name")), F.lit("EXT PRICE"))
    title = F.when(F.col("n_regionkey") == 0, F.col("n_name")).otherwise("")
    return load(spark, sf_dir, "nation").select(
        "n_nationkey", display.wide_column(kind, heads).cast("int").alias("wide"), F.array_join(F.transform(display.figure_columns(kind, heads), lambda b: b.cast("string")), " ").alias("figures"),
        display.shown_title(title, kind).alias("title"), display.base_name(F.concat("n_name", F.lit(".part.pdf"))).alias("file"),
    )


@query("SELECT o_orderkey, o_orderstatus AS status, '-' AS side FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT o_orderkey, 'X', '+' FROM orders WHERE o_orderkey % 50 = 0")
def moved_lines(spark, sf_dir):
    before = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    after = before.withColumn("status", F.when(F.col("o_orderkey") % 50 == 0, "X").otherwise(F.col("status")))
    return review.moved_lines(before, after)


@query("SELECT CAST(c_custkey AS VARCHAR) AS doc, CAST(c_custkey % 100 AS DOUBLE) AS x, CAST(25 AS DOUBLE) AS y, CAST(length(c_mktsegment) AS DOUBLE) AS width, c_custkey % 2 = 0 AS low FROM customer")
def word_overlay(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc"), F.lit(1).alias("page"), F.col("c_custkey").alias("word_id"), F.col("c_mktsegment").alias("text"), ((F.col("c_custkey") % 100) * 10.0).alias("x"), F.lit(500.0).alias("y"), (F.length("c_mktsegment") * 10.0).alias("width"), F.lit(20.0).alias("height"), F.when(F.col("c_custkey") % 2 == 0, 0.5).otherwise(0.55).alias("confidence"))
    pages = c.select("doc", "page", F.lit(1000).alias("width"), F.lit(2000).alias("height")).distinct()
    return review.overlay(c, pages).select("doc", "x", "y", "width", "low")


# Goods printed with all that a column table can carry: stacked titles, names on lines of their own, a second table.
GOODS_XS = [0.0, 100.0, 460.0, 640.0, 840.0]
GOODS_SQL = """
    goods AS (
        SELECT p_partkey // 60 AS doc, p_partkey, row_number() OVER (PARTITION BY p_partkey // 60 ORDER BY p_partkey) - 1 AS n, CAST(p_size AS VARCHAR) AS qty, upper(p_name) AS name, lower(p_type) AS kind,
            'P' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS code, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS price, CAST(CAST(p_retailprice * p_size AS DECIMAL(18,2)) AS VARCHAR) AS total
        FROM part
    ), placed AS (SELECT *, CAST(n // 12 + 1 AS INT) AS page, n % 12 AS line FROM goods)"""


def goods_words(spark, sf_dir):
    """Twelve parts a page, sixty a document. Every third prints its kind on a line below, every fifth its name on the line above.

    Titles stand on one line, or on two in even documents; from page 2 on, documents
    divisible by three print none. Pages close with a subtotal and a second table of three suppliers' balances.
    """
    paged = number_pages(load(spark, sf_dir, "part"), F.expr("cast(p_partkey div 60 as string)"), ["p_partkey"], 12)
    text = lambda c: F.col(c).cast("string")
    code, name = F.concat(F.lit("P"), F.lpad(text("p_partkey"), 7, "0")), F.upper("p_name")
    above, below = F.col("line") % 5 == 4, F.col("line") % 3 == 1
    blank = F.lit("")
    row = F.array(text("p_size"), F.when(above, "").otherwise(name), code, decimal_text("p_retailprice"), decimal_text(F.col("p_retailprice") * F.col("p_size")))
    lines = F.array(
        F.when(above, F.struct((F.col("line") * 120).alias("y"), F.array(blank, name, blank, blank, blank).alias("cells"))), F.struct((F.col("line") * 120 + 24).alias("y"), row.alias("cells")),
        F.when(below, F.struct((F.col("line") * 120 + 48).alias("y"), F.array(blank, F.lower("p_type"), blank, blank, blank).alias("cells"))))
    body = paged.select("doc", "page", F.explode(F.filter(lines, lambda l: l.isNotNull())).alias("l")).select("doc", "page", (F.col("l.y") + 200.0).alias("y"), "l.cells")
    pages = paged.select("doc", "page").distinct()
    titled = pages.where("page = 1 OR cast(doc as bigint) % 3 <> 0")
    one = F.struct(F.lit(160.0).alias("y"), F.array(*map(F.lit, ("CASE QTY", "DESCRIPTION", "ITEM CODE", "UNIT PRICE", "AMOUNT"))).alias("cells"))
    two = F.array(F.struct(F.lit(136.0).alias("y"), F.array(*map(F.lit, ("CASE", "", "ITEM", "UNIT", ""))).alias("cells")), F.struct(F.lit(160.0).alias("y"), F.array(*map(F.lit, ("QTY", "DESCRIPTION", "CODE", "PRICE", "AMOUNT"))).alias("cells")))
    heads = titled.select("doc", "page", F.explode(F.when(F.col("doc").cast("long") % 2 == 0, two).otherwise(F.array(one))).alias("l")).select("doc", "page", "l.*")
    sums = pages.select("doc", "page", F.lit(1700.0).alias("y"), F.array(blank, F.lit("SUB TOTAL"), blank, blank, F.lit("99.00")).alias("cells"))
    return print_fields(body.unionByName(heads).unionByName(sums), GOODS_XS).unionByName(balance_words(spark, sf_dir, titled))


def balance_words(spark, sf_dir, pages):
    """Under each page: the balances of the three suppliers that follow its document's number."""
    many = load(spark, sf_dir, "supplier").agg(F.count("*").alias("many"))
    picks = pages.join(F.broadcast(many)).select("doc", "page", "many", F.posexplode(F.array(*map(F.lit, (0, 1, 2)))).alias("i", "k")).select("doc", "page", "i", ((F.col("doc").cast("long") + F.col("page") + F.col("k")) % F.col("many") + 1).alias("s_suppkey"))
    owed = picks.join(load(spark, sf_dir, "supplier"), "s_suppkey").select("doc", "page", (F.lit(1960.0) + F.col("i") * 24).alias("y"), F.array(F.lit("01/15"), F.lpad(F.col("s_suppkey").cast("string"), 6, "7"), decimal_text(F.abs("s_acctbal"))).alias("cells"))
    heads = pages.select("doc", "page", F.explode(F.array(
        F.struct(F.lit(1900.0).alias("y"), F.array(F.lit("Previous Balances"), F.lit(""), F.lit("")).alias("cells")), F.struct(F.lit(1930.0).alias("y"), F.array(F.lit("DATE"), F.lit("INVOICE#"), F.lit("BALANCE")).alias("cells")))).alias("l")).select("doc", "page", "l.*")
    return print_fields(owed.unionByName(heads), [0.0, 300.0, 700.0])


@query(f"""WITH {GOODS_SQL} SELECT CAST(doc AS VARCHAR) AS doc, page, CAST(line AS INT) AS row_no, 'CASE QTY, DESCRIPTION, ITEM CODE, UNIT PRICE, AMOUNT' AS titles, qty,
        name || CASE WHEN line % 3 = 1 THEN ' ' || kind ELSE '' END AS name, code, price, total FROM placed""")
def read_column_tables(spark, sf_dir):
    rows = column_tables.read_rows(column_tables.read_tables(goods_words(spark, sf_dir))).where("nth = 0")
    return rows.select("doc", "page", F.col("row").alias("row_no"), F.array_join("headers", ", ").alias("titles"), *named(rows, "qty", "name", "code", "price", "total"))


@query(f"""WITH {GOODS_SQL}, pages AS (SELECT DISTINCT doc, page FROM placed WHERE page = 1 OR doc % 3 <> 0), picks AS (SELECT doc, page, i, (doc + page + i) % (SELECT count(*) FROM supplier) + 1 AS s FROM pages, range(3) r(i))
    SELECT CAST(doc AS VARCHAR) AS doc, page, CAST(i AS INT) AS row_no, 'Previous Balances' AS title, '01/15' AS day, lpad(CAST(s_suppkey AS VARCHAR), 6, '7') AS invoice, CAST(CAST(abs(s_acctbal) AS DECIMAL(18,2)) AS VARCHAR) AS balance
    FROM picks JOIN supplier ON s_suppkey = s""")
def read_further_tables(spark, sf_dir):
    tables = column_tables.read_tables(goods_words(spark, sf_dir)).where("nth = 1")
    rows = tables.select("doc", "page", "title", F.explode("rows").alias("r")).select("doc", "page", "title", "r.*")
    return rows.select("doc", "page", F.col("row").alias("row_no"), "title", *named(rows, "day", "invoice", "balance"))


@query(f"""WITH {GOODS_SQL} SELECT CAST(doc AS VARCHAR) AS doc, page, 'summary' AS reason, 'SUB TOTAL  99.00' AS text, CAST(1700 AS DOUBLE) AS y FROM placed GROUP BY ALL
    UNION ALL SELECT CAST(doc AS VARCHAR), page, 'unplaced', 'Previous  Balances', 1900 FROM placed WHERE page = 1 OR doc % 3 <> 0 GROUP BY ALL""")
def left_out_lines(spark, sf_dir):
    """Totals, and the heading of the second table, which lies under the first."""
    return column_tables.left_out(column_tables.read_tables(goods_words(spark, sf_dir))).select("doc", "page", "reason", "text", "y")


@query(f"""WITH {GOODS_SQL}, titled AS (SELECT * FROM placed WHERE page = 1 OR doc % 3 <> 0),
    ink AS (SELECT doc, page, max(100 + 10 * greatest(length(name), CASE WHEN line % 5 = 4 THEN 0 ELSE length(name) END)) FILTER (line % 5 <> 4) AS names FROM titled GROUP BY ALL)
    SELECT CAST(doc AS VARCHAR) AS doc, page, 460 - least((460 - names) / 2.0, 30.0) AS code_edge FROM ink""")
def settled_edges(spark, sf_dir):
    """The edge between names and codes: three characters in front of the codes, or half way where the names come nearer."""
    tables = column_tables.read_tables(goods_words(spark, sf_dir)).where("nth = 0 AND titled")
    return tables.select("doc", "page", F.element_at("bounds", 3).alias("code_edge"))


# Intervals: returned and kept lines of a supplier, from order key modulo 1000, as long as their quantity.
SPANS_SQL = "iv AS (SELECT l_suppkey, l_returnflag, CAST(l_orderkey % 1000 AS DOUBLE) AS lo, CAST(l_orderkey % 1000 AS DOUBLE) + l_quantity AS hi FROM lineitem)"


@query(f"WITH {SPANS_SQL} SELECT a.l_suppkey, CAST(count(*) AS BIGINT) AS pairs, CAST(sum(least(a.hi, b.hi) - greatest(a.lo, b.lo)) AS DOUBLE) AS shared FROM iv a JOIN iv b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = 'A' AND b.l_returnflag = 'R' AND a.lo < b.hi AND b.lo < a.hi GROUP BY ALL")
def overlapping_intervals(spark, sf_dir):
    lo = (F.col("l_orderkey") % 1000).cast("double")
    iv = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", lo.alias("lo"), (lo + F.col("l_quantity")).alias("hi"))
    pairs = geometry.overlap_join(iv.where("l_returnflag = 'A'").drop("l_returnflag"), iv.where("l_returnflag = 'R'").drop("l_returnflag"), ["l_suppkey"], 25.0)
    return pairs.groupBy("l_suppkey").agg(F.count("*").alias("pairs"), F.sum(F.least("hi", "other_hi") - F.greatest("lo", "other_lo")).alias("shared"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, epoch_us(CAST(ts AS TIMESTAMP)) / 1000000.0 AS sec FROM events),
    a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS nth, sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS gap FROM e WHERE event_type = 'click'),
    p AS (SELECT user_id, coalesce(median(gap) FILTER (gap > 4), 3600) AS pitch FROM a GROUP BY user_id),
    m AS (SELECT e.user_id, e.event_id AS item, a.event_id AS anchor, row_number() OVER (PARTITION BY e.user_id, e.event_id ORDER BY abs(e.sec - a.sec) + CASE WHEN e.sec - a.sec >= -pitch * 0.3 * 0.5 THEN 0 ELSE pitch * 0.75 END, a.nth) AS r
        FROM e JOIN p USING (user_id) JOIN a USING (user_id) WHERE e.event_type <> 'click' AND e.sec - a.sec BETWEEN -pitch * 0.3 AND pitch * 0.6)
    SELECT user_id, item, anchor FROM m WHERE r = 1""")
def assign_rows(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1000000).alias("at"))
    nth = F.row_number().over(W.partitionBy("user_id").orderBy("at", "event_id"))
    anchors = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("anchor"), "at", nth.alias("nth"))
    return geometry.assign_rows(e.where("event_type <> 'click'").select("user_id", F.col("event_id").alias("item"), "at"), anchors, ["user_id"], 3600.0).select("user_id", "item", "anchor")


@query("SELECT p_partkey, upper(p_name) || ' ' || p_brand AS text, CAST(length(p_name || p_brand) + 1 AS INT) AS n_spans FROM part")
def restore_spaces(spark, sf_dir):
    """Names glued by a recogniser, ten pixels a character: parted by glyph counts, every third by spans alone as its counts are off."""
    named_ = load(spark, sf_dir, "part").select("p_partkey", F.split(F.concat_ws(" ", F.upper("p_name"), "p_brand"), " ").alias("ws"))
    sized = named_.withColumn("n", F.transform("ws", F.length))
    start = F.transform("n", lambda _, i: F.aggregate(F.slice("n", 1, i), F.lit(0), lambda a, k: a + k + 1))
    placed = sized.withColumn("at", start)
    spans = F.flatten(F.zip_with("at", "n", lambda a, k: F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct(((a + i) * 10.0).cast("double").alias("lo"), ((a + i) * 10.0 + 9).cast("double").alias("hi")))))
    gaps = F.transform(F.slice("at", 2, F.size("at") - 1), lambda a: (a * 10.0 - 5).cast("double"))
    counts = F.transform("n", lambda k, i: F.when((F.col("p_partkey") % 3 == 0) & (i == 0), k + 1).otherwise(k))
    made = placed.select("p_partkey", recogniser.restore_spaces(F.array_join("ws", ""), spans, gaps, counts).alias("r"))
    return made.select("p_partkey", "r.text", F.size("r.spans").alias("n_spans"))


@query("SELECT p_partkey, upper(p_name) || ' A B ' || p_size AS label FROM part")
def clean_labels(spark, sf_dir):
    """Names with two spaced letters and a size, a fragment far left of them and another far right, and a lone mark between."""
    p = load(spark, sf_dir, "part").repartition("p_partkey")  # a small file is one task, its labels are work for many
    ws = F.split(F.upper("p_name"), " ")
    n = F.length("p_name")
    word = lambda x, text: F.struct(x.cast("double").alias("x"), F.lit(0.0).alias("y"), text.alias("text"), (F.length(text) * 10.0).cast("double").alias("width"), F.lit(20.0).alias("height"))
    named_ = F.transform(ws, lambda w, i: word(300 + F.length(F.array_join(F.slice(ws, 1, i), " ")) * 10.0 + F.when(i > 0, 10).otherwise(0), w))
    end = 300 + n * 10.0 + 10
    rest = F.array(word(F.lit(10.0), F.lit("ii")), word(end, F.lit("A")), word(end + 20, F.lit("B")), word(end + 40, F.lit("|")), word(end + 60, F.col("p_size").cast("string")), word(end + 300, F.lit("zz")))
    return p.select("p_partkey", finding.label_words(F.concat(named_, rest)).alias("label"))


@query(f"WITH {REVIEW_SQL} SELECT CAST(o_custkey AS VARCHAR) AS doc, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (review) AS BIGINT) AS flagged, CAST(count(*) FILTER (o_orderkey % 4 = 0) AS BIGINT) AS edited, CAST(count(*) FILTER (NOT review) AS BIGINT) AS valid FROM s GROUP BY o_custkey")
def grid_stats(spark, sf_dir):
    rows = review_rows(spark, sf_dir).where("row % 4 = 0").select("doc", "page", "row")
    return review.grid_stats(_status(spark, sf_dir), rows.unionAll(rows))


@query("""WITH l AS (SELECT l_suppkey, l_linenumber, l_shipinstruct FROM (SELECT l_suppkey, l_linenumber, l_linestatus || l_returnflag AS l_shipinstruct FROM lineitem))
    SELECT CAST(l_suppkey AS VARCHAR) AS doc, CAST(count(DISTINCT l_linenumber) AS BIGINT) AS pages FROM l WHERE contains(lower(l_shipinstruct), 'fr') GROUP BY l_suppkey""")
def matched_pages(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("doc"), F.col("l_linenumber").alias("page"), F.array(F.concat("l_linestatus", "l_returnflag")).alias("cells"))
    return review.matched_pages(review.search(rows, "FR"))


@query("""WITH l AS (SELECT o_custkey // 8 AS doc, o_orderkey, row_number() OVER (PARTITION BY o_custkey // 8 ORDER BY o_orderkey) - 1 AS n, lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS pack, strftime(o_orderdate, '%m/%d/%y') AS day FROM orders),
    p AS (SELECT *, n // 25 + 1 AS page, count(*) FILTER (o_orderkey % 3 <> 0) OVER (PARTITION BY doc, n // 25) >= 3 AS known FROM l),
    w AS (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN [pack, '7UP', day] WHEN known THEN [pack, '7UP', day] ELSE [pack || '7', 'UP', day] END AS ws,
        CASE WHEN o_orderkey % 3 <> 0 THEN [0, 12, 16] WHEN known THEN [0, 11, 14] ELSE [0, 12, 14] END AS places FROM p)
    SELECT CAST(doc AS VARCHAR) AS doc, CAST(page AS INT) AS page, CAST((n % 25) * 100000 + i AS BIGINT) AS word_id, ws[i + 1] AS text, CAST(60 + 10 * places[i + 1] AS DOUBLE) AS x FROM w, range(3) r(i)""")
def page_words(spark, sf_dir):
    """Lines of packs, every third glued: the length of a pack code is known from the page's other lines, or from none where they are too few."""
    paged = number_pages(load(spark, sf_dir, "orders"), F.expr("cast(o_custkey div 8 as string)"), ["o_orderkey"], 25)
    pack = F.concat(F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"), F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0"))
    text = F.array_join(F.array(pack, F.lit("7UP"), F.date_format("o_orderdate", "MM/dd/yy")), "")
    spaced = F.array_join(F.array(pack, F.lit("7UP"), F.date_format("o_orderdate", "MM/dd/yy")), " ")
    lines = paged.select("doc", "page", "line", F.when(F.col("o_orderkey") % 3 == 0, text).otherwise(spaced).alias("text"), F.lit(60.0).alias("x"), (F.col("line") * 30.0).alias("y"), F.lit(20.0).alias("height"), F.lit(1.0).alias("confidence"))
    lines = lines.withColumn("width", (F.length("text") * 10.0).cast("double"))
    return recogniser.page_words(lines, ["doc", "page"]).select("doc", "page", "word_id", "text", "x")


@query(f"""WITH {GOODS_SQL}, packs AS (SELECT o_custkey // 8 AS doc, (row_number() OVER (PARTITION BY o_custkey // 8 ORDER BY o_orderkey) - 1) // 25 + 1 AS page FROM orders)
    SELECT 'goods ' || doc AS doc, page, 'table' AS kind, CAST(count(*) AS INT) AS n_rows, 'CASE QTY' AS first_title FROM placed GROUP BY ALL
    UNION ALL SELECT 'packs ' || doc, CAST(page AS INT), 'settlements', count(*), 'Game-Pack' FROM packs GROUP BY ALL""")
def read_pages(spark, sf_dir):
    """Documents of two kinds, read by what their pages turn out to be."""
    marked = lambda words, kind: words.withColumn("doc", F.concat(F.lit(f"{kind} "), "doc"))
    words = marked(goods_words(spark, sf_dir), "goods").unionByName(marked(settlement_words(spark, sf_dir), "packs"))
    return reading.read_pages(words).select("doc", "page", "kind", F.size("rows").alias("n_rows"), F.element_at("headers", 1).alias("first_title"))


@query("""SELECT l_orderkey, replace(replace(string_agg(t, ' ' ORDER BY x, t), ' -', '-'), '- ', '-') AS label, c AS nth
    FROM (SELECT l_orderkey, l_linenumber * 60 + l_quantity AS x, CASE WHEN l_quantity % 3 = 0 THEN '-' ELSE '' END || l_returnflag || l_linenumber || CASE WHEN l_quantity % 4 = 0 THEN '-' ELSE '' END AS t,
            CAST(CASE WHEN l_linenumber * 60 + l_quantity + 10 >= 300 THEN 2 WHEN l_linenumber * 60 + l_quantity + 10 >= 150 THEN 1 ELSE 0 END AS INT) AS c FROM lineitem)
    GROUP BY l_orderkey, c""")
def split_labels(spark, sf_dir):
    """Title words that stand over one column's edge make one label, hyphens without blanks."""
    mark = lambda n: F.when(F.col("l_quantity") % n == 0, "-").otherwise("")
    word = F.struct((F.col("l_linenumber") * 60 + F.col("l_quantity")).cast("double").alias("x"), F.lit(0.0).alias("y"), F.concat(mark(3), "l_returnflag", F.col("l_linenumber").cast("string"), mark(4)).alias("text"), F.lit(10.0).alias("width"), F.lit(20.0).alias("height"))
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(word).alias("words"))
    starts = F.array(*map(F.lit, (0.0, 150.0, 300.0)))
    used = F.array_sort(F.array_distinct(F.transform("words", lambda w: titles.start_index(w["x"], starts, F.lit(10.0)))))
    labels = lines.select("l_orderkey", used.alias("columns"), titles.split_labels(F.col("words"), starts).alias("labels"))
    pairs = labels.select("l_orderkey", F.explode(F.arrays_zip("columns", "labels")).alias("p"))
    return pairs.select("l_orderkey", F.col("p.labels").alias("label"), F.col("p.columns").cast("int").alias("nth"))


@query("SELECT s_suppkey, s_suppkey % 50 + 40.5 AS left_edge, CAST(400 + s_suppkey % 7 AS DOUBLE) AS right_edge, CAST(100 + greatest(s_suppkey % 3, s_suppkey % 4) + 20 AS DOUBLE) AS top_edge FROM supplier WHERE s_suppkey % 5 <> 0")
def name_columns(spark, sf_dir):
    """Pages whose titles were read give the Name column; every fifth lacks the counts' titles."""
    line = lambda i, t, x, y, w: F.struct(F.lit(i).alias("line_id"), F.lit(t).alias("text"), x.cast("double").alias("x"), (F.lit(100) + y).cast("double").alias("y"), F.lit(w).alias("width"), F.lit(20.0).alias("height"))
    key = F.col("s_suppkey")
    early = line(0, "game name", key * 0 + 999, key * 0, 10.0)
    counts = line(2, "Int Rec Act Set", 400 + key % 7, key % 4, 300.0)
    other = line(2, "Rec Act Set", 400 + key % 7, key % 4, 300.0)
    pages = load(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(early, line(1, "Game  Name", key % 50, key % 3, 90.0), F.when(key % 5 == 0, other).otherwise(counts))).alias("l"))
    found = recogniser.name_columns(pages.select("s_suppkey", "l.*"), ["s_suppkey"])
    return found.select("s_suppkey", F.col("left").alias("left_edge"), F.col("right").alias("right_edge"), F.col("top").alias("top_edge"))
