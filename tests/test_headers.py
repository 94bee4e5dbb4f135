"""Golden cases of finding titles: words, stacks, parted titles, several tables."""

from pyspark.sql import functions as F

from tablewright.operators import headers
from tablewright.operators.headers import WORD

GLYPH = 8.0


def print_words(lines):
    """(y, [(text, x)]) as words 10 high, 8 a character."""
    return [(float(x), float(y), t, GLYPH * len(t), 10.0) for y, ws in lines for t, x in ws]


BODY = [(60, [("3", 0), ("AB1234", 100), ("1.50", 200), ("4.50", 300)]), (80, [("2", 0), ("CD9876", 100), ("2.25", 200), ("4.50", 300)])]


CASES = {
    "two words": [(40, [("CASE", 0), ("QTY", 36), ("ITEM", 100), ("CODE", 136), ("UNIT", 200), ("PRICE", 236), ("EXT", 300), ("AMOUNT", 328)]), *BODY],
    "stacked on a line without hits": [(26, [("Whole", 100), ("Each", 200)]), (40, [("QTY", 0), ("ITEM#", 100), ("PRICE", 200), ("TOTAL", 300)]), *BODY],
    "two lines above": [(12, [("Per", 200)]), (26, [("Each", 200)]), (40, [("QTY", 0), ("ITEM#", 100), ("PRICE", 200), ("TOTAL", 300)]), *BODY],
    "prose above": [(26, [("Our", 0), ("house", 60), ("of", 110), ("fine", 130), ("goods", 200)]), (40, [("QTY", 0), ("ITEM#", 100), ("PRICE", 200), ("TOTAL", 300)]), *BODY],
    "priced line": [(40, [("QTY", 0), ("TOTAL", 100), ("PRICE", 200), ("9.99", 300)])],
    "two titles": [(40, [("QTY", 0), ("PRICE", 100)])],
    "empty": [],
    "parted": [(40, [("CASE", 0), ("QTY", 38), ("ITEM#", 100), ("PRICE", 200)]), (60, [("3", 8), ("7", 46), ("AB12", 100), ("1.50", 200)]), (80, [("4", 8), ("9", 46), ("CD34", 100), ("2.50", 200)])],
    "one filled row": [(40, [("CASE", 0), ("QTY", 38), ("ITEM#", 100), ("PRICE", 200)]), (60, [("3", 8), ("7", 46), ("AB12", 100), ("1.50", 200)]), (80, [("4", 8), ("CD34", 100), ("2.50", 200)])],
    "straddled": [(40, [("CASE", 0), ("QTY", 38), ("ITEM#", 100), ("PRICE", 200)]), (60, [("3", 8), ("7", 46), ("AB12", 100), ("1.50", 200)]), (80, [("4", 8), ("9", 46), ("CD34", 100), ("2.50", 200)]), (100, [("123456", 10)])],
    "large below small": [(0, [("QTY", 0), ("UNIT", 100), ("PRICE", 200)]), (20, BODY[0][1]), (40, [*BODY[1][1], ("EA", 400)]), (200, [("QTY", 0), ("ITEM#", 100), ("PRICE", 200), ("TOTAL", 300)]), (220, BODY[0][1]), (240, BODY[1][1])],
}
FOUR = ["QTY", "ITEM#", "PRICE", "TOTAL"]
WANT = {
    "two words": (["CASE QTY", "ITEM CODE", "UNIT PRICE", "EXT AMOUNT"], 40.0), "stacked on a line without hits": (["QTY", "Whole ITEM#", "Each PRICE", "TOTAL"], 26.0),
    "two lines above": (["QTY", "ITEM#", "Per Each PRICE", "TOTAL"], 12.0), "prose above": (FOUR, 40.0), "parted": (["CASE", "QTY", "ITEM#", "PRICE"], 40.0),
    "one filled row": (["CASE QTY", "ITEM#", "PRICE"], 40.0), "straddled": (["CASE QTY", "ITEM#", "PRICE"], 40.0), "large below small": (FOUR, 200.0),
}


def test_header_finder_on_golden_pages(spark):
    pages = spark.createDataFrame([(name, 1, print_words(lines)) for name, lines in CASES.items()], f"doc string, page int, words array<{WORD}>")
    got = {h.doc: ([c.label for c in h.columns], h.top) for h in headers.find_header(pages).collect()}
    assert got == WANT
    top = {h.doc: h.top for h in headers.find_header(pages.where("doc = 'large below small'"), True).collect()}
    assert top == {"large below small": 0.0}


def test_headers_down_the_page_and_printed_bounds(spark):
    lines = [(0, [("QTY", 0), ("ITEM#", 100), ("PRICE", 200), ("TOTAL", 300)]), (20, BODY[0][1]), (40, BODY[1][1]), (100, [("DATE", 0), ("INVOICE#", 100), ("BALANCE", 260)]), (120, [("01/02", 0), ("4455", 100), ("7.00", 260)]), (140, [("01/03", 0), ("4456", 100), ("8.00", 260)])]
    pages = spark.createDataFrame([("d", 1, 10.0, print_words(lines)), ("d", 2, 10.0, print_words(lines[:3])), ("d", 3, 10.0, [])], f"doc string, page int, line_height double, words array<{WORD}>")
    hs = headers.find_headers(pages).select("page", "nth", "columns", headers.column_bounds(F.col("columns")).alias("b")).orderBy("page", "nth").collect()
    want = ["QTY", "ITEM#", "PRICE", "TOTAL"]
    assert [(h.page, h.nth, [c.label for c in h.columns]) for h in hs] == [(1, 0, want), (1, 1, ["DATE", "INVOICE#", "BALANCE"]), (2, 0, want)]
    # a wide gap after a short title: the edge stands on that title's shoulder
    assert hs[0].b == [-4.0, 24 + 24 * 0.45, 199.0, 240 + 60 * 0.22 if 60 > 60 else 299.0]
