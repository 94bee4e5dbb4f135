"""Golden cases of titles: stacks, labels, scores, spans, gutters."""

from pyspark.sql import functions as F

from tablewright.operators import titles

W = "array<struct<text string, x double, y double, width double, height double>>"


def one(spark, words, *columns):
    """words: (text, x, y, width), each 10 high"""
    df = spark.createDataFrame([([(*w, 10.0) for w in words],)], f"w {W}")
    return df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_stacked_titles_and_labels(spark):
    words = [("Ordered", 0.0, 0.0, 70.0), ("Qty", 20.0, 14.0, 30.0), ("UNIT", 100.0, 1.0, 40.0), ("PRICE", 145.0, 0.0, 50.0), ("SUB-", 300.0, 0.0, 40.0), ("TOTAL", 300.0, 14.0, 50.0)]
    cols, tokens = one(spark, words, titles.title_columns(F.col("w"), F.lit(10.0)), titles.label_tokens(F.slice("w", 3, 3)))
    assert [(c.x, c.right, c.label) for c in cols] == [(0.0, 70.0, "Ordered Qty"), (100.0, 195.0, "UNIT PRICE"), (300.0, 350.0, "SUB-TOTAL")]
    assert tokens == ["UNIT PRICE SUB-"]  # of two gaps the upper is the middle one, and none reaches 1.8 of it


def test_scores_and_kinds(spark):
    row = spark.range(1).select(
        titles.header_score(F.array(*map(F.lit, ("QTY", "ITEM#", "DESCRIPTION", "PRICE"))), F.array(*map(F.lit, ("3", "A1", "pears", "1.00"))), F.lit(3)).alias("good"),
        titles.header_score(F.array(*map(F.lit, ("12", "3.50"))), F.lit(None).cast("array<string>"), F.lit(3)).alias("figures"),
        titles.lottery_titles(F.array(*map(F.lit, ("Game-Pack", "Name", "Date Settled")))).alias("packs"), titles.lottery_titles(F.array(*map(F.lit, ("QTY", "PRICE")))).alias("goods"),
        titles.usable_guide(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(1.0), F.lit(2.0))).alias("guide"), titles.printed_label(F.lit("Rcc"), "Rec").alias("label"),
        titles.default_headers(F.lit("invoice")).alias("heads"),
    ).first()
    assert row.good == 18 + 28 + 12 + 26 + 4 + 18 and row.figures == 0
    assert row.packs and not row.goods and not row.guide and row.label == "Rcc" and row["heads"] == ["label", "value"]


def test_spans(spark):
    spans = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(50.0).alias("right")), F.struct(F.lit(100.0).alias("x"), F.lit(150.0).alias("right")))
    row = spark.range(1).select(
        titles.title_of(F.lit(90.0), F.lit(140.0), spans).alias("second"), titles.title_of(F.lit(0.0), F.lit(150.0), spans).alias("both"), titles.sits_under(F.lit(40.0), F.lit(60.0), spans[0]).alias("under"),
        titles.starts_in_column(F.lit(90.0), F.array(F.lit(0.0), F.lit(95.0)), F.lit(1), F.lit(5.0)).alias("starts"), titles.start_index(F.lit(97.0), F.array(F.lit(0.0), F.lit(100.0)), F.lit(5.0)).alias("at"),
    ).first()
    assert row.second == 1 and row.both == -1 and row.under and row.starts and row.at == 1


def test_gutter_bounds(spark):
    body = spark.createDataFrame([("d", 1, 0.0, 40.0), ("d", 1, 10.0, 55.0), ("d", 1, 80.0, 120.0), ("d", 1, 122.0, 160.0)], "doc string, page int, lo double, hi double")
    cols = spark.createDataFrame([("d", 1, 0, 0.0, 30.0, 0.0, 10.0), ("d", 1, 1, 90.0, 110.0, 89.0, 10.0), ("d", 1, 2, 130.0, 150.0, 129.0, 10.0)], "doc string, page int, col int, x double, right double, printed double, height double")
    assert sorted((r.col, r.bound) for r in titles.gutter_bounds(body, cols).collect()) == [(0, 0.0), (1, 67.5), (2, 129.0)]


def test_labels_by_the_edges_of_the_rows(spark):
    word = lambda t, x: F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y"), F.lit(t).alias("text"), F.lit(10.0 * len(t)).alias("width"), F.lit(20.0).alias("height"))
    line = F.array(word("CODE", 196), word("QTY", 60), word("PRE-", 400), word("TAX", 450), word("ITEM", 150), word(" ", 300))
    edges = lambda *xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<double>")
    got = spark.range(1).select(titles.split_labels(line, edges(60.0, 200.0, 400.0)).alias("a"), titles.split_labels(line, edges(60.0)).alias("b"), titles.label_tokens(line).alias("c"), titles.split_labels(F.slice(line, 6, 1), edges(60.0, 200.0)).alias("d")).first()
    assert got.a == ["QTY ITEM", "CODE", "PRE-TAX"] and got.b == got.c and got.d == []
