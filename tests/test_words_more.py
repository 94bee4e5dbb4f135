"""Golden cases of overlap joins, row anchors, labels and restored blanks."""

import random

from pyspark.sql import functions as F

from tablewright.operators import geometry, recogniser
from tablewright.operators import words as finding


def test_overlap_join_is_the_inequality_join(spark):
    rnd = random.Random(4)
    side = lambda n: [(rnd.choice("ab"), i, x := rnd.choice([0.0, 10.0, rnd.uniform(-50, 200)]), x + rnd.choice([0.0, 5.0, 10.0, rnd.uniform(0, 130)])) for i in range(n)] + [("a", None, None, 5.0), (None, 1, 0.0, 5.0)]
    a, b = side(80), side(60)
    got = geometry.overlap_join(spark.createDataFrame(a, "k string, i int, lo double, hi double"), spark.createDataFrame(b, "k string, j int, lo double, hi double"), ["k"], 10.0)
    want = sorted((p[1], q[1]) for p in a for q in b if None not in (p[0], p[2], q[0], q[2]) and p[0] == q[0] and p[2] < p[3] and q[2] < q[3] and p[2] < q[3] and q[2] < p[3])
    assert sorted((r.i, r.j) for r in got.collect()) == want and want


def test_rows_reach_down_further_than_up(spark):
    anchors = spark.createDataFrame([("p", i, 100.0 * i, i) for i in range(4)], "k string, anchor int, at double, nth int")
    at = [0.0, 55.0, 65.0, 75.0, 86.0, 110.0, 250.0, 999.0]
    items = spark.createDataFrame([("p", i, a) for i, a in enumerate(at)], "k string, item int, at double")
    got = {r.item: r.anchor for r in geometry.assign_rows(items, anchors, ["k"], 24.0).collect()}
    # 55 is 55 below row 0 and 45 above row 1: only 30 count upwards; 75 lies in the dear half of the reach, 86 in the cheap one
    assert got == {0: 0, 1: 0, 3: 1, 4: 1, 5: 1, 6: 2}


def words(*items):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y"), F.lit(t).alias("text"), F.lit(10.0 * len(t)).alias("width"), F.lit(20.0).alias("height")) for t, x in items])


def test_labels_lose_strays_and_keep_spaced_letters(spark):
    cases = {
        "RED WHITE": [("ii", 0), ("RED", 200), ("WHITE", 240)], "longer": [("longer", 0), ("RED", 200)], "longer CRIMSON": [("longer", 0), ("CRIMSON", 200)], "A B C": [("A", 200), ("B", 220), ("C", 240)], "LUCKY 7": [("LUCKY", 200), ("7", 260), ("zz", 400)],
        "NAME": [("NAME", 200), ("x", 270), ("|", 300)], "$50 OR $100!": [("$50", 200), ("OR", 240), ("$100!", 270)], "": [("--", 0)], "BIG & NEW": [(".BIG,", 200), ("&", 260), ("NEW.", 280)],
    }
    got = spark.range(1).select(*[finding.label_words(words(*c)).alias(f"c{i}") for i, c in enumerate(cases.values())]).first()
    assert list(got) == list(cases)


def test_restored_spaces_by_counts_spans_and_neither(spark):
    spans = lambda *xs: F.array(*[F.struct(F.lit(float(x)).alias("lo"), F.lit(float(x + 9)).alias("hi")) for x in xs])
    gap = lambda *xs: F.array(*map(F.lit, map(float, xs))).cast("array<double>")
    n = lambda *xs: F.array(*map(F.lit, xs)).cast("array<int>")
    cases = [
        (("REDONE", spans(0, 10, 20, 40, 50, 60), gap(35), n(3, 3)), "RED ONE"), (("REDONE", spans(0, 10, 20, 40, 50, 60), gap(5), n(3, 3)), "RED ONE"), (("REDONE", spans(0, 10, 20, 40, 50, 60), gap(35), n(3, 4)), "RED ONE"),
        (("RE DONE", spans(0, 10, 20, 30, 40, 50, 60), gap(35), n(3, 3)), "RED ONE"), (("REDONE", spans(0, 10, 20), gap(35), n(3, 3)), "REDONE"), (("REDONE", spans(0, 10, 20, 40, 50, 60), gap(), n(6)), "REDONE"),
        (("AB", spans(0, 10), gap(900), n(1)), "AB"), (("REDONE", spans(0, 10, 20, 40, 50, 60), gap(35), n()), "RED ONE"), (("", spans(), gap(3), n(1)), ""),
    ]
    empty = "array<struct<lo: double, hi: double>>"
    got = spark.range(1).select(*[recogniser.restore_spaces(F.lit(t), s.cast(empty), g, k).alias(f"c{i}") for i, ((t, s, g, k), _) in enumerate(cases)]).first()
    assert [r.text for r in got] == [w for _, w in cases]
    assert [(s.lo, s.hi) for s in got[0].spans][3] == (29.0, 40.0)


def test_lines_become_words_in_two_passes(spark):
    rows = [
        ("d", 1, 0, "815-445566 LUCKY 01/02/24"), ("d", 1, 1, "815-445567 RED"), ("d", 1, 2, "816-445568 BLUE"), ("d", 1, 3, " 817-4455697 UP01/03/24 "), ("d", 1, 4, "   "), ("d", 1, 5, None),
        ("d", 2, 0, "817-4455697UP"),
    ]
    lines = spark.createDataFrame(rows, "doc string, page int, line int, text string").withColumn("width", F.length("text") * 10.0)
    lines = lines.selectExpr("*", "100D AS x", "0D AS y", "20D AS height", "0.9D AS confidence").withColumn("width", F.coalesce("width", F.lit(1.0)).cast("double"))
    got = {}
    for w in sorted(recogniser.page_words(lines, ["doc", "page"]).collect(), key=lambda w: (w.page, w.word_id)):
        got.setdefault((w.page, w.word_id // 100_000), []).append((w.text, round(w.x, 6), round(w.width, 6)))
    assert got[1, 0] == [("815-445566", 100.0, 100.0), ("LUCKY", 210.0, 50.0), ("01/02/24", 270.0, 80.0)]
    assert [w[0] for w in got[1, 3]] == ["817-445569", "7", "UP", "01/03/24"]  # six digits, as the page's others have
    assert [w[0] for w in got[2, 0]] == ["817-4455697", "UP"] and set(got) == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)}
    spans = F.transform(F.sequence(F.lit(0), F.length("text") - 1), lambda i: F.struct((i * 7.0).cast("double").alias("lo"), (i * 7.0 + 6).cast("double").alias("hi")))
    read = {(w.text, w.x, w.width) for w in recogniser.page_words(lines.where("line = 3").withColumn("spans", spans), ["doc", "page"]).collect()}
    assert ("UP", 13 * 7.0, 13.0) in read
