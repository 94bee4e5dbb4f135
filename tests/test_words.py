"""Findings on words against hand-made pages, empty tables included."""

from pyspark.sql import functions as F

from tablewright.functions import display
from tablewright.operators import export, review, words

SCHEMA = "doc string, page int, line_id long, word_id long, text string, x double, y double, width double, height double, confidence double"


def made(spark, rows):
    return spark.createDataFrame([("d", 1, line, i, text, float(x), float(y), 40.0, 20.0, 1.0) for i, (line, text, x, y) in enumerate(rows)], SCHEMA)


def test_pack_codes_and_counts_stay_whole(spark):
    got = words.split_counts(made(spark, [(0, "123-456789", 0, 0), (0, "123456", 100, 0), (0, "12", 200, 0), (0, "001002003004005", 300, 0)])).orderBy("x").collect()
    assert [r.text for r in got] == ["123-456789", "123", "456", "12", "001002003004005"]
    assert words.split_counts(made(spark, [])).count() == 0


def test_halves_far_apart_are_no_pack(spark):
    got = words.line_packs(made(spark, [(0, "881", 0, 0), (0, "023234", 60, 0), (1, "881", 0, 50), (1, "023234", 90, 50)])).collect()
    assert [(r.line_id, r.pack, r.halves) for r in got] == [(0, "881-023234", 2)]


def lone(spark, rows):
    df = made(spark, [(0, t, x, y) for t, x, y in rows])
    marked = df.withColumns({"pack": F.when(F.col("text").startswith("P"), F.col("text")), "date": F.when(F.col("text").startswith("D"), F.col("text"))})
    return sorted(r.text for r in words.with_lone_dates(marked).where("lone").collect())


def test_lone_dates_stand_in_the_column_of_the_others(spark):
    three = [("P1", 0, 0), ("D1", 500, 0), ("P2", 0, 30), ("D2", 500, 30), ("P3", 0, 90), ("D3", 500, 90)]
    assert lone(spark, [*three, ("D4", 500, 60), ("D5", 700, 60 + 120)]) == ["D4"]
    assert lone(spark, [*three, ("D4", 500, 60), ("D5", 505, 60)]) == []  # two dates in a band
    assert lone(spark, [*three, ("D4", 500, 300)]) == []  # far below
    assert lone(spark, three[:4] + [("D4", 500, 60)]) == []  # fewer than three packs
    assert lone(spark, []) == []


def test_document_json_of_one_page_and_of_repeated_titles(spark):
    pages = spark.createDataFrame([("d", 1, "table", None, ["A", "A"], [["1", 'say "2"'], ["3"]])], "doc string, page int, kind string, title string, headers array<string>, rows array<array<string>>")
    totals = spark.createDataFrame([("d", 1)], "doc string, total int")
    assert [r.json for r in export.document_json(pages, totals).collect()] == ['{"kind":"table","headers":["A","A"],"rows":[{"A":"say \\"2\\""},{"A":""}]}']
    assert export.document_json(pages.limit(0), totals).count() == 0


def test_page_column_gets_a_free_name(spark):
    layout = spark.createDataFrame([("d", 0, "Page", 0, "Page"), ("e", 0, "page", 0, "page")], "doc string, ord int, title string, nth int, key string")
    assert {r.doc: (r.page_title, r.page_key) for r in export.page_key(layout).collect()} == {"d": ("PDF Page", "page"), "e": ("Page", "pdfPage")}


def test_moved_lines_count_repeats(spark):
    before, after = (spark.createDataFrame([(x,) for x in xs], "line string") for xs in (["a", "a", "b"], ["a", "b", "c"]))
    assert sorted((r.line, r.side) for r in review.moved_lines(before, after).collect()) == [("a", "-"), ("c", "+")]


def test_base_names(spark):
    got = spark.createDataFrame([("a.b.pdf",), (".pdf",), (None,)], "f string").select(display.base_name(F.col("f")).alias("n")).collect()
    assert [r.n for r in got] == ["a.b", "document", "document"]
