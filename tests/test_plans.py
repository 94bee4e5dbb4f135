"""What plans and steps cost: no pass over the words twice, no expression worked out once a mention, no batch as Python objects."""

import re
import time

import pyarrow as pa
from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.functions.arrays import once
from tablewright.operators import export, geometry, layout, readers, skips, tables
from tests.test_tables import page

WORDS = "doc string, page int, word_id long, text string, x double, y double, width double, height double, confidence double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_read_in_one_pass(spark):
    """one scan of the words, and the kinds' patterns stand in the plan once, not in a filter again."""
    p = plan(tables.column_kinds(tables.table_rows(tables.read_lines(spark.createDataFrame([], WORDS)))))
    assert len(re.findall("Scan ExistingRDD|LocalTableScan", p)) == 1 and p.count("merchandise") <= 3


def test_skipped_lines_and_reasons_in_one_pass(spark):
    """left-out lines come from one pass, their reasons from windows: no join of the lines with themselves."""
    lines = spark.createDataFrame([], "doc string, page int, line_id long, headers array<string>, cells array<string>, text string, notes array<string>, confidence double, x double, y double, bottom double, height double, kind string")
    lefts = spark.createDataFrame([], "doc string, page int, body_left double")
    p = plan(skips.refine(tables.skipped_lines(lines), lefts))
    assert len(re.findall(r"Scan ExistingRDD\[|LocalTableScan ", p)) <= 2


def test_wraps_in_one_pass(spark):
    """continuations are found on the page's own lines, and belong as before."""
    words = page(spark, [[["1", "GREEN KETTLE", "18.40"], ["", "made to last", ""], ["", "and more", ""], ["2", "WOOL SOCKS", "6.15"], ["", "", "far"]]])
    rows = tables.wrapped_rows(tables.read_lines(words))
    assert [r.cells[1] for r in rows.orderBy("row").collect()] == ["GREEN KETTLE made to last and more", "WOOL SOCKS"]
    assert plan(tables.wrapped_rows(tables.read_lines(spark.createDataFrame([], WORDS)))).count("Join") == 0


def test_dates_and_packs_are_worked_out_once(spark):
    """a date's patterns stand in the plan a few times, not once a mention."""
    assert plan(readers.settlements(spark.createDataFrame([], WORDS))).count("12][0-9]|3[01]") <= 3
    shown = ["01/02/24", "1/02/24", "011/02/24", "01/012/24", "01022024", "99/99/99", "x", None]
    got = spark.createDataFrame([(s,) for s in shown], "t string").select(T.settled_date(F.col("t"))).collect()
    assert [r[0] for r in got] == ["01/02/24", None, "01/02/24", "01/12/24", "01/22/24", None, None, None]


def test_once_keeps_filters_out(spark):
    df = once(spark.createDataFrame([("a1",)], "t string"), u=F.regexp_replace("t", "[0-9]", "")).where("u = 'a' AND length(u) = 1")
    assert df.collect()[0].u == "a" and plan(df).count("regexp_replace") == 1


def test_export_shuffles_pages_not_cells(spark):
    """cells meet their columns inside their page's row."""
    df = spark.createDataFrame([("d", 1, "table", ["A", "B"], [["1", "2"], ["3"], []]), ("d", 2, "table", ["B", "B", "A"], [["4", "5", None]])], "doc string, page int, kind string, headers array<string>, rows array<array<string>>")
    got = {(r.page, r.row): r.cells for r in export.export_rows(df).collect()}
    assert got == {(1, 0): ["1", "2", ""], (1, 1): ["3", "", ""], (2, 0): ["", "4", "5"]}
    last = plan(export.export_rows(df)).split("Exchange")[0]
    assert "Generate" in last  # cells part after the last shuffle


def test_edges_are_settled_by_slices(spark, monkeypatch):
    """Only a slice of an Arrow batch is ever Python objects."""
    seen = []
    monkeypatch.setattr(layout, "_edges", lambda t: [float(t)])
    df = spark.createDataFrame([(i, i) for i in range(100)], "k int, asked int").coalesce(1)
    run = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: run.append(f))
    layout.settle_edges(df, ["k"])
    out = list(run[0](iter([pa.RecordBatch.from_pydict({"k": list(range(100)), "asked": list(range(100))})])))
    assert max(b.num_rows for b in out) <= layout.AT_ONCE and [e for b in out for [e] in b.column("edges").to_pylist()] == [float(i) for i in range(100)]


def test_keyed_figures_in_one_scan(spark):
    """a long line without a figure costs one scan, not one from each of its letters; counts are as before."""
    shown = ["Total: 1 Tax: $2.50", "A b. c : 12,5 d:7", "a:b: 3", "x: y", ": 5 a: 6", "1:2 3:4"]
    old = r"[A-Za-z][A-Za-z.\s]*:\s*\$?-?[0-9,]+(?:\.[0-9]+)?"
    df = spark.createDataFrame([(s,) for s in shown], "t string").select(T.is_document_total(F.col("t")), F.regexp_count("t", F.lit(old)) >= 2)
    assert all(a == b for a, b in df.collect())
    long = spark.range(1).select(T.is_document_total(F.repeat(F.lit("words "), 60000)).alias("t"))
    began = time.time()
    assert long.collect()[0].t is False and time.time() - began < 20


def test_small_files_are_spread(spark, sf_dir):
    """labels, cuts and invoices are worked out behind an exchange on their key."""
    from tablewright import catalog

    for name in ("split_counts", "clean_labels", "validate_invoice", "read_weekly_invoice"):
        assert "REPARTITION_BY_COL" in plan(catalog.QUERIES[name](spark, sf_dir)), name


def test_words_are_gathered_once_and_lines_judged_by_compiled_steps(spark):
    """one row a line comes from one grouping of its words, without a window over a line; no step that a generator interprets holds a line's tests."""
    p = plan(tables.table_rows(tables.read_lines(spark.createDataFrame([], WORDS))))
    assert len(re.findall("ObjectHashAggregate|SortAggregate", p)) <= 2 and p.count("Window [") <= 5
    assert all("lambda" not in line for line in p.split("\n") if "Generate" in line)


def test_figures_need_no_interpreted_step(spark):
    """what a column holds is worked out without a function over an array a cell."""
    cells = spark.createDataFrame([], "doc string, page int, cells array<string>, label boolean")
    assert "lambda" not in plan(tables.column_kinds(cells))


def test_line_fields_are_fields(spark):
    """a line's fields gathered in one step are those of ``fields``: gaps, currency signs, uneven heights, words at one place."""
    words = [("d", 1, 1, "$", 0.0, 10.0, 20.0), ("d", 1, 2, "12.50", 60.0, 50.0, 20.0), ("d", 1, 3, "a", 200.0, 10.0, 20.0), ("d", 1, 4, "b", 215.0, 10.0, 10.0), ("d", 1, 5, "c", 240.0, 10.0, 12.0),
             ("d", 1, 6, "e", 240.0, 5.0, 12.0), ("d", 1, 7, "far", 900.0, 30.0, 30.0), ("d", 2, 1, "lone", 5.0, 40.0, 20.0), ("d", 2, 2, "wide", 61.0, 40.0, 20.0)]
    rows = spark.createDataFrame([(d, p, i, t, x, 0.0, w, h, i / 10) for d, p, i, t, x, w, h in words], WORDS)
    lines = geometry.group_lines(rows)
    old = tables.field_lines(geometry.fields(lines)).drop("titles")
    key = lambda r: (r.doc, r.page, r.line_id)
    for a, b in zip(sorted(old.collect(), key=key), sorted(geometry.line_fields(lines).select(old.columns).collect(), key=key), strict=True):
        assert a.fs == b.fs and abs(a.confidence - b.confidence) < 1e-9 and a[5:] == b[5:]


def test_tests_of_whole_lines_agree_with_those_cell_by_cell(spark):
    """items told from a line's joined cells, rules, repeated titles and sums behind a first search are what they were cell by cell."""
    bits = ["12", " 7 ", "-3", "(5)", "1,234", "A-12", "12345", "P0000001", "900.10", "$ 9.99", "large ring", "x9.99", "**", "*12*", "", "  ", "9.99 ea", "12\n", "a\x01b", "1\x012", "SUB-TOTAL", "Taxes", "QTY", "item 2"]
    lines = [[a, b, c] for a in bits for b in bits for c in ("", "QTY", "4.00")] + [[], ["12"], ["QTY", "ITEM", "PRICE"], ["QTY", "ITEM#", "9", "PRICE"], ["item 2", "QTY", "Price"]]
    df = spark.createDataFrame([(x,) for x in lines], "c array<string>").select("c", T.is_line_item(F.col("c")).alias("got"), T._is_line_item(F.col("c")).alias("want"))
    assert df.where("got IS DISTINCT FROM want").collect() == [] and 0 < df.where("got").count() < len(lines)
    heads = F.array(*map(F.lit, ["QTY", "ITEM#", "PRICE"]))
    again = spark.createDataFrame([(x,) for x in lines], "c array<string>").where(T.is_repeated_header(F.col("c"), heads)).collect()
    assert sorted(map(tuple, (r.c for r in again))) == [("QTY", "ITEM", "PRICE"), ("QTY", "ITEM#", "9", "PRICE"), ("QTY", "QTY", "QTY")]
    rules = ["----", "- - = *", "---", " -\n-.. ", "----x", "", "\t====\n", "a----", "- " * 20_000, None]
    drawn = F.regexp_replace("t", r"\s", "").rlike(r"^[-_=.*]{4,}$")
    assert spark.createDataFrame([(t,) for t in rules], "t string").where(~T.is_rule(F.col("t")).eqNullSafe(drawn)).collect() == []
    figures = ["12", "* 12", "12 A", "1.50 T", "1.50T", "$ 1.5", "(1.25)", " 7", "7 ", "abc", "A 1", "1,234.5678-", "", None, "** 3.00 *", "9\n"]
    bare = F.trim(F.regexp_replace(F.regexp_replace("t", r"^[*\s]+", ""), r"\s+[A-Z*]$", ""))
    old = T.is_quantity(bare) | bare.rlike(r"^[(-]?\$?\s?-?[0-9,]*[0-9]\.[0-9]{1,4}\)?-?$")
    assert spark.createDataFrame([(t,) for t in figures], "t string").where(~T.is_figure(F.col("t")).eqNullSafe(old)).collect() == []
