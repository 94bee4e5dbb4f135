import json

from pyspark.sql import functions as F

from tablewright.operators import checks, export, recogniser, review, skips
from tablewright.plans import printer
from tablewright.sources import pages
from tablewright.streaming import ingest


def test_files_by_first_bytes(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.png").write_bytes(b"\x89PNG")
    (tmp_path / "c.txt").write_bytes(b"%PDF-")
    assert {(r.path.rsplit("/", 1)[1], r.is_pdf) for r in pages.files(spark, str(tmp_path)).collect()} == {("a.pdf", True), ("b.png", False)}


def test_posted_pages_and_text_layer(spark):
    body = {"page": 1, "headers": ["QTY", "PRICE"], "rows": [{"cells": ["1", "18.40"], "confidence": 0.9}]}
    got = pages.posted_pages(spark.createDataFrame([("d", json.dumps(body)), ("e", "{}")], "doc string, body string")).orderBy("doc").collect()
    assert (got[0].kind, got[0].rows, got[1].kind, got[1].rows) == ("table", [["1", "18.40"]], "table", [])
    boxes = spark.createDataFrame([("d", 1, "abcdef", 7.2, 0.0, 36.0, 0.1)] * 8 + [("d", 2, "x", 0.0, 0.0, 1.0, 1.0), ("d", 1, " ", 0.0, 0.0, 1.0, 1.0)], "doc string, page int, text string, x double, y double, width double, height double")
    words = pages.scaled_words(boxes)
    assert words.count() == 9 and words.where("page = 1").first().height == 1.0
    assert [(r.doc, r.page) for r in pages.usable_pages(words).collect()] == [("d", 1)]


def test_word_stream_reads_tables(spark, tmp_path):
    rows = spark.createDataFrame([("d", 1, 0, ["1", "GREEN KETTLE", "18.40"]), ("d", 1, 1, ["2", "WOOL SOCKS", "6.15"])], "doc string, page int, line int, cells array<string>")
    words = printer.print_table(rows, ["QTY", "DESCRIPTION", "PRICE"], [60.0, 200.0, 700.0], F.lit(True))
    words.coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{n} {t}" for n, t in words.dtypes)
    query = ingest.stream_rows(ingest.word_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert sorted(r.cells[1] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["GREEN KETTLE", "WOOL SOCKS"]


def test_event_windows_stream(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(str(tmp_path / "in"))
    stream = ingest.event_windows(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) AS n FROM hours").first().n == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_inventory_checks(spark):
    cells = [["101", "A", "001", "002", "", "004"], ["102", "B", "010", "", "030", "x"], ["103", "C", "100", "200", "300", ""], ["", "TOTALS", "111", "999", "333", "004"]]
    rows = spark.createDataFrame([("d", 1, i, c) for i, c in enumerate(cells)], "doc string, page int, row int, cells array<string>")
    solved = checks.solve_counts(checks.count_columns(rows))
    got = {(r.row, r.pos): (r["count"], r.solved) for r in solved.collect()}
    assert got[0, 2] == (3, True) and got[1, 1] == (797, True) and got[1, 3] == (None, False)
    issues = sorted((r.code, r.rows) for r in checks.inventory_issues(solved).collect())
    assert issues == [("inventory-solved", [0]), ("inventory-solved", [1]), ("inventory-unread", [1, 2])]


def test_export_shapes(spark):
    rows = [("d", 1, "table", ["QTY", "PRICE", "PRICE"], [["1", "2", "3"]]), ("d", 2, "table", ["PRICE", "qty"], [["4", "5", "x"]]), ("d", 3, "table", ["GAME"], [])]
    df = spark.createDataFrame(rows, "doc string, page int, kind string, headers array<string>, rows array<array<string>>")
    assert [r.key for r in export.document_layout(df).orderBy("ord").collect()] == ["QTY", "PRICE", "PRICE (2)", "qty", "Column 3"]
    csv = export.document_csv(df, spark.createDataFrame([("d", 4)], "doc string, total int")).first().csv
    assert csv == "Page,QTY,PRICE,PRICE,qty,Column 3\r\n1,1,2,3,,\r\n2,,4,,5,x"
    assert [r.page for r in export.missing_pages(df, spark.createDataFrame([("d", 4)], "doc string, total int")).collect()] == [4]
    named = df.where("page = 1").withColumn("headers", F.array(F.lit("Page"), F.lit("page"), F.lit("x")))
    assert export.page_key(export.document_layout(named)).first()[1:] == ("PDF Page", "pdfPage")


def test_log_and_review(spark):
    log = spark.createDataFrame([("d", 2, "note", "OUT OF STOCK", 0.9), ("d", 1, "note", "OUT OF STOCK", 0.5), ("d", 3, "unplaced", 'a "b"', 1.0)], "doc string, page int, reason string, text string, confidence double")
    failed = spark.createDataFrame([("d", 4, "no words")], "doc string, page int, message string")
    csv = skips.log_csv(skips.log_groups(log, failed)).first().csv.split("\r\n")
    assert csv[1:] == ['yes,Not placed in a column,3,1,"a ""b""",1.00', "yes,Page produced no rows,4,1,no words,", "no,Note cut from an item,1-2,2,OUT OF STOCK,0.50"]
    rows = spark.createDataFrame([("d", 1, 0, "table", ["a", ""], 0.9, False), ("d", 1, 1, "table", ["", ""], 0.9, True), ("d", 1, 2, "invoice", ["a", "b"], 0.54, False)], "doc string, page int, row int, kind string, cells array<string>, confidence double, label boolean")
    none = spark.createDataFrame([], "doc string, page int, row int")
    issues = spark.createDataFrame([], "doc string, page int, code string, rows array<int>")
    assert {r.row: r.review for r in review.row_status(rows, none, issues).collect()} == {0: True, 1: False, 2: True}


def test_pixels():
    import numpy as np

    page = np.full((40, 30), 255, np.uint8)
    page[10:30, 2:8] = page[10:30, 20:26] = 0
    assert recogniser.ink_gaps(page) == [(8, 20)]
    assert recogniser.ink_level(np.array([0, 48, 88, 128, 255], np.uint8)).tolist() == [0, 48, 100, 255, 255]
    rgb = np.full((60, 4, 3), 200, np.uint8)
    rgb[:50, 1] = (200, 20, 20)
    grey, share = recogniser.suppress_colour(rgb)
    assert (grey[:50, 1] == 255).all() and grey[0, 0] == 200 and 0 < share < 1
