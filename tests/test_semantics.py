"""Golden cases: what readers must answer beyond what the printer prints."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import checks, export, geometry, recogniser, tables

LABELS = ["FWD BALANCE", "ON-LINE NET DUE", "INSTANT NET DUE", "NON-GAME ADJUSTMENTS", "SYSTEM FEE", "OTHER RETAILER INCENTIVES"]


def issues(spark, fields):
    rows = [("d", 1, i, label, value) for i, (label, value) in enumerate(fields)]
    got = checks.invoice_issues(spark.createDataFrame(rows, "doc string, page int, row int, label string, value string"))
    return {(r.code, tuple(r.rows)) for r in got.collect()}


def test_invoice_block_and_sections(spark):
    block = [(x, "1.00") for x in LABELS]
    assert issues(spark, [*block, ("TOTAL DUE BY WED", "6.00")]) == set()
    assert issues(spark, [("TOTAL DUE BY WED", "6.01"), *block]) == {("invoice-total", (1, 2, 3, 4, 5, 6, 0))}
    assert issues(spark, [*block[1:], ("TOTAL DUE BY WED", "9.00")]) == set()  # only with the whole block read
    assert issues(spark, [("On-line Net Due", "1.00"), ("NET SALES", "1.00"), ("NET SALES", "2.00"), ("ON-LINE NET DUE", "2.00")]) == {("invoice-section-total", (0, 3))}


def words(spark, rows):
    """rows: (text, x, y, width, height, confidence)"""
    return spark.createDataFrame([("d", 1, i, *r) for i, r in enumerate(rows)], "doc string, page int, word_id long, text string, x double, y double, width double, height double, confidence double")


def test_weekly_marks_run_over_words(spark):
    assert tables.weekly_invoices(words(spark, [("FWD", 0.0, 0.0, 9.0, 9.0, 1.0), ("BALANCE", 10.0, 0.0, 9.0, 9.0, 1.0), ("System", 0.0, 20.0, 9.0, 9.0, 1.0), ("Fee:", 10.0, 20.0, 9.0, 9.0, 1.0)])).count() == 1
    assert tables.weekly_invoices(words(spark, [("FWD BALANCE", 0.0, 0.0, 9.0, 9.0, 1.0)])).count() == 0


def test_a_tall_word_joins_the_line_it_stands_in(spark):
    w = words(spark, [("low", 0.0, 0.0, 9.0, 10.0, 1.0), ("TALL", 20.0, 0.0, 9.0, 30.0, 1.0), ("next", 0.0, 40.0, 9.0, 10.0, 1.0)])
    for form in (geometry.group_lines, geometry.group_lines_exact):
        assert {r.text: r.line_id for r in form(w).collect()} == {"low": 0, "TALL": 0, "next": 1}


def test_confidence_is_the_mean_over_words(spark):
    y, out = 0.0, []
    for cells in (["QTY", "DESCRIPTION", "PRICE"], ["2", "FINE RED BAG", "5.00"]):
        for text, x in zip(cells, (10.0, 200.0, 600.0), strict=True):
            for k, part in enumerate(text.split(" ")):
                out.append((part, x + 60 * k, y, 50.0, 20.0, 0.2 if part == "BAG" else 1.0))
        y += 40
    item = tables.read_lines(words(spark, out)).where("kind = 'item'").first()
    assert item.confidence == pytest.approx(4.2 / 5)


@pytest.mark.parametrize(("lines", "kind", "want"), [
    (["Retailer 12 Invoice", "PACKSETTLEMENTS", "Date Settled"], "settlements", "PACK SETTLEMENTS"),
    (["Weekly Invoice for 12 Some Street"], "invoice", "WEEKLY INVOICE"), (["ACME LTD INVOICE #: 12345 PAGE 1"], "table", "Invoice # 12345"),
    (["STATE LOTTERY", "Order of goods"], "table", "Order of goods"), (["plain words"], "table", None),
])
def test_titles(spark, lines, kind, want):
    got = tables.page_titles(words(spark, [(t, 0.0, 40.0 * i, 300.0, 12.0, 1.0) for i, t in enumerate(lines)]), kind).collect()
    assert (got[0].title if got else None) == want


def test_edges_follow_the_mean_so_far(spark):
    rows = [("d", i // 5, float(9 * (i % 5)), 10.0) for i in range(40)]
    got = geometry.repeated_edges(spark.createDataFrame(rows, "doc string, line_id long, x double, height double"), ["doc"]).collect()
    assert sorted((r.edge, r.n) for r in got) == [(4.5, 16), (22.5, 16), (36.0, 8)]


def test_structural_cuts(spark):
    cases = [("881-023234DIAMONDS", None, ["881-023234", "DIAMONDS"]), ("833-12998620X", 6, ["833-129986", "20X"]), ("833-12998620X", None, ["833-12998620", "X"]), ("FUN01/02/24NOW", None, ["FUN", "01/02/24", "NOW"]), ("881-023234", 6, ["881-023234"]), ("200X", 6, ["200X"])]
    df = spark.createDataFrame(cases, "token string, digits int, want array<string>")
    assert all(r.got == r.want for r in df.withColumn("got", recogniser.structural_cuts(F.col("token"), F.col("digits"))).collect())


def test_votes_need_all_rereadings(spark):
    cases = [("0n l1ne", ["On line", "Online"], "On line"), ("0n", ["On", "Oon"], "0n"), ("10X", ["10x", "10x"], "10X"), ("0n", [], "0n"), ("0n", ["On", "Qn"], "0n"), ("F1n", ["Ｆin"], "Fin")]
    df = spark.createDataFrame(cases, "original string, readings array<string>, want string").withColumn("readings", recogniser.compatible("readings"))
    assert all(r.got == r.want for r in df.withColumn("got", recogniser.vote_characters(F.col("original"), F.col("readings"))).collect())


def test_a_blank_page_says_nothing_of_the_kind(spark):
    pages = spark.createDataFrame([("d", 1, "table", [["x"]]), ("d", 2, "inventory", []), ("e", 1, "table", []), ("e", 2, "invoice", [])], "doc string, page int, kind string, rows array<array<string>>")
    assert {r.doc: r.kind for r in export.document_kinds(pages).collect()} == {"d": "table", "e": "mixed"}
