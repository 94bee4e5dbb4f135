"""Golden pages of inventories whose rows slope, overlap, lack anchors or print no titles."""

from pyspark.sql import functions as F

from tablewright.operators import inventories

TITLES = [("Game", 60, 100), ("Name", 160, 100), ("Int", 600, 100), ("Rec", 700, 100), ("Act", 800, 100), ("Set", 900, 100)]
KINDS = "doc string, page int, word_id long, text string, x double, y double, width double, height double, confidence double"


def read(spark, **pages):
    rows = [(doc, 1, i, t, float(x), float(y), 10.0 * len(t), 20.0, 1.0) for doc, words in pages.items() for i, (t, x, y) in enumerate(words)]
    got = inventories.anchored_inventory(spark.createDataFrame(rows, KINDS)).orderBy("doc", "page", "row").collect()
    return {doc: [list(r.cells) for r in got if r.doc == doc] for doc in pages}


def stock(y, game, name, counts, slope=0.0, xs=(600, 700, 800, 900)):
    return [(game, 60, y), *[(w, 160 + 60 * i, y + slope * 100) for i, w in enumerate(name.split())], *[(c, x, y + slope * (x - 60)) for c, x in zip(counts, xs) if c]]


def test_rows_by_anchor(spark):
    sloping = TITLES + stock(130, "101", "RED FOX", ["001", "002", "003", "004"], 0.02) + stock(160, "102", "OWL", ["010", "020", "030", "040"], 0.02) + stock(190, "103", "ELK", ["100", "200", "300", "400"], 0.02)
    damaged = TITLES + stock(130, "201", "CAT", ["5", "0O7", "", "xyz"]) + stock(160, "202", "DOG", ["001002003004"], xs=(600,)) + [("TOTALS", 160, 190), ("006", 600, 190), ("009", 700, 190)] + stock(250, "999", "FOOTER", ["1", "2", "3", "4"])
    untitled = stock(130, "301", "ANT", ["001", "002", "003", "004"]) + stock(160, "302", "BEE", ["005", "006", "007", "008"]) + stock(190, "303", "FLY", ["009", "010", "", "012"]) + stock(220, "304", "GNU", ["013", "014", "015", "016"])
    got = read(spark, sloping=sloping, damaged=damaged, untitled=untitled)
    assert got["sloping"] == [["101", "RED FOX", "001", "002", "003", "004"], ["102", "OWL", "010", "020", "030", "040"], ["103", "ELK", "100", "200", "300", "400"]]
    assert got["damaged"] == [["201", "CAT", "005", "007", "", ""], ["202", "DOG", "001", "002", "003", "004"], ["", "TOTALS", "006", "009", "", ""]]
    assert got["untitled"][2] == ["303", "FLY", "009", "010", "", "012"] and len(got["untitled"]) == 4


def test_rows_without_columns_and_without_anchors(spark):
    one = stock(130, "401", "HEN $5", ["001", "002", "003", "004"])
    none = [("letter", 60, 100), ("of", 160, 100), ("intent", 300, 100), ("Name", 60, 130), ("1", 600, 130)]
    got = read(spark, one=one, none=none, blank=[(" ", 60, 100)])
    assert got == {"one": [["401", "HEN $5", "001", "002", "003", "004"]], "none": [], "blank": []}


def test_titles_in_order_with_two_exact(spark):
    page = lambda *t: [(w, 100 + 100 * i, 100) for i, w in enumerate(t)]
    pages = {"good": page("Gane", "Int", "Rcc", "Act", "Sct"), "poor": page("Imt", "Rcc", "Act", "Sct"), "mixed": page("Rec", "Int", "Act", "Set"), "late": page("Set", "Int", "Rec", "Act", "Set")}
    rows = [(doc, 1, i, t, float(x), float(y), 30.0, 20.0, 1.0) for doc, words in pages.items() for i, (t, x, y) in enumerate(words)]
    from tablewright.operators.geometry import group_lines

    got = {r.doc: list(r.centres) for r in inventories.count_titles(group_lines(spark.createDataFrame(rows, KINDS))).collect()}
    assert got == {"good": [215.0, 315.0, 415.0, 515.0], "late": [215.0, 315.0, 415.0, 515.0]}


def test_equally_near_centres(spark):
    words = F.array(F.struct(F.lit(45.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1).alias("word_id"), F.lit(10.0).alias("width"), F.lit("7").alias("text"), F.lit(1.0).alias("confidence")))
    centres = F.array(*map(F.lit, (0.0, 100.0, 200.0, 300.0)))
    assert list(spark.range(1).select(inventories.read_counts(words, centres, F.lit(100.0))).first()[0]) == ["", "007", "", ""]
