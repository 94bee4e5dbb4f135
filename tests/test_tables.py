from pyspark.sql import functions as F

from tablewright.operators import geometry as G
from tablewright.operators import tables
from tablewright.plans import printer

XS = [60.0, 200.0, 700.0]


def page(spark, lines, titled=(True,)):
    rows = [("d", p + 1, i, cells) for p, ls in enumerate(lines) for i, cells in enumerate(ls)]
    df = spark.createDataFrame(rows, "doc string, page int, line int, cells array<string>")
    return printer.print_table(df, ["QTY", "DESCRIPTION", "PRICE"], XS, F.col("page").isin([i + 1 for i, t in enumerate(titled) if t]))


def test_rows_and_log(spark):
    words = page(spark, [[["1", "GREEN KETTLE", "18.40"], ["2", "WOOL SOCKS OUT OF STOCK", "6.15"], ["QTY", "DESCRIPTION", "PRICE"], ["", "SUB TOTAL", "24.55"], ["Page 1 of 2", "", ""], ["----", "-----", ""], ["", "just words", ""]], [["3", "CLAY BOWL", "9.90"]]], (True, False))
    lines = tables.read_lines(words)
    got = [(r.page, r.row, r.cells) for r in tables.table_rows(lines).orderBy("page", "row").collect()]
    assert got == [(1, 0, ["1", "GREEN KETTLE", "18.40"]), (1, 1, ["2", "WOOL SOCKS", "6.15"]), (2, 0, ["3", "CLAY BOWL", "9.90"])]
    log = {(r.reason, r.text) for r in tables.skipped_lines(lines).collect()}
    assert log == {("repeated-header", "QTY DESCRIPTION PRICE"), ("summary", "SUB TOTAL 24.55"), ("furniture", "Page 1 of 2"), ("unplaced", "just words"), ("note", "OUT OF STOCK")}
    kinds = {(r.page, r.col): r.kind for r in tables.column_kinds(tables.table_rows(lines)).collect()}
    assert kinds[1, 0] == "figure" and kinds[1, 1] == "text" and kinds[1, 2] == "figure"


def test_lines_both_ways_and_interleaved(spark):
    rows = [("d", 1, i, t, x, y, 10.0, 20.0, 1.0) for i, (t, x, y) in enumerate([("a", 0.0, 0.0), ("b", 30.0, 4.0), ("c", 0.0, 30.0), ("d", 30.0, 26.0)])]
    words = spark.createDataFrame(rows, "doc string, page int, word_id long, text string, x double, y double, width double, height double, confidence double")
    want = {"a": (0, 0), "b": (0, 1), "c": (1, 0), "d": (1, 1)}
    assert {r.text: (r.line_id, r.nth) for r in G.group_lines(words).collect()} == want
    assert {r.text: (r.line_id, r.nth) for r in G.group_lines_exact(words).collect()} == want


def test_glyphs_and_overprints(spark):
    cols = "doc string, page int, word_id long, text string, x double, y double, width double, height double, confidence double"
    glyphs = [("d", 1, i, c, 10.0 * i + (20 if i > 2 else 0), 0.0, 10.0, 20.0, 1 - i / 10) for i, c in enumerate("abcde")]
    got = G.merge_glyphs(G.group_lines(spark.createDataFrame(glyphs, cols))).orderBy("word").collect()
    assert [(r.text, r.x, r.width, round(r.confidence, 2)) for r in got] == [("abc", 0.0, 30.0, 0.8), ("de", 50.0, 20.0, 0.6)]
    twice = [("d", 1, i, "x", 10.0 + 0.3 * i, 0.0, 1.0, 20.0, 1.0) for i in range(4)] + [("d", 1, 9, "y", 10.0, 0.0, 10.0, 20.0, 1.0)]
    kept = G.without_overprints(G.group_lines(spark.createDataFrame(twice, cols))).collect()
    assert sorted((r.text, round(r.x, 1)) for r in kept) == [("x", 10.0), ("x", 10.3), ("x", 10.9), ("y", 10.0)]


def test_intervals_and_anchors(spark):
    spans = spark.createDataFrame([(1, 0.0, 5.0), (1, 5.0, 7.0), (1, 9.0, 12.0), (1, 10.0, 11.0)], "k int, lo double, hi double")
    assert sorted((r.lo, r.hi) for r in G.union_spans(spans, ["k"]).collect()) == [(0.0, 7.0), (9.0, 12.0)]
    swept = G.coverage(spans, ["k"])
    assert sorted((r.lo, r.hi, r.depth) for r in swept.collect()) == [(0.0, 5.0, 1), (5.0, 7.0, 1), (7.0, 9.0, 0), (9.0, 10.0, 1), (10.0, 11.0, 2), (11.0, 12.0, 1)]
    assert [(r.lo, r.hi) for r in G.gutters(swept, ["k"]).collect()] == [(7.0, 9.0)]
    items = spark.createDataFrame([(1, 1, 10.0), (1, 2, 24.0), (1, 3, 90.0), (1, 4, 15.0)], "k int, item int, at double")
    anchors = spark.createDataFrame([(1, 7, 10.0), (1, 8, 20.0)], "k int, anchor int, at double")
    got = {r.item: r.anchor for r in G.assign_to_anchors(items, anchors, ["k"], 5.0, 5.0).collect()}
    assert got == {1: 7, 2: 8, 4: 7}
