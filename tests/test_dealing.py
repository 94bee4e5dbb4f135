"""Work is dealt by its rows, and what several steps name is worked out once."""

from pyspark.sql import functions as F

from tablewright import catalog
from tablewright.functions import text as T
from tablewright.operators import column_tables, geometry, inventories, reading, tables
from tablewright.operators.words import count_parts, with_lone_dates
from tablewright.sources.rest import dealt


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_partitions_grow_with_rows(spark):
    assert [dealt(spark.range(10), n, "id").rdd.getNumPartitions() for n in (0, 250_000)] == [1, 6]


def test_stock_is_counted_once_for_all_issues(spark, sf_dir):
    assert plan(catalog.QUERIES["validate_inventory"](spark, sf_dir)).count("Join") == 1


def test_anchored_rows_stand_on_words_at_rest(spark, sf_dir):
    """No step prints the words again, and a line that holds no four counts is no candidate."""
    got = plan(catalog.QUERIES["anchored_inventory"](spark, sf_dir))
    assert "Relation [" not in got and "LogicalRDD" in got


def test_may_count_is_no_less_than_what_is_counted(spark):
    texts = ["001002003004", "1", "(12)", "123-456", "#001 002,", "1234", "a1b", "1a2", "P0000123", "01/02/96", "", ":001.002;", "12345678901234567890"]
    counts = F.size(F.filter(F.transform(count_parts(F.col("t")), T.count_value), lambda c: c.isNotNull()))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", inventories.may_count(F.col("t")).alias("most"), counts.alias("n")).collect()
    assert all(r.most >= r.n for r in rows) and {r.t for r in rows if r.most == 0} == {"1234", "1a2", "P0000123", "01/02/96", "", "12345678901234567890"}


def test_words_in_lines_are_not_grouped_again(spark):
    words = spark.createDataFrame([("d", 1, 1, "a", 0.0, 0.0, 10.0, 20.0), ("d", 1, 2, "b", 20.0, 4.0, 10.0, 20.0), ("d", 1, 3, "c", 0.0, 30.0, 10.0, 20.0)], "doc string, page int, word_id long, text string, x double, y double, width double, height double")
    lines = geometry.group_lines(words)
    assert plan(geometry.group_lines(lines.withColumn(geometry.LINED, F.lit(True)))).count("Window") == plan(lines).count("Window")
    moved = lines.withColumn("line_id", F.lit(9))  # not marked: grouped anew
    assert sorted((r.word_id, r.line_id, r.nth) for r in geometry.group_lines(moved).collect()) == [(1, 0, 0), (2, 0, 1), (3, 1, 0)]


WORDS = "doc string, page int, word_id long, text string, x double, y double, width double, height double, confidence double"


def test_documents_without_titles_are_not_read_for_tables(spark, monkeypatch):
    """words of documents without a page of three title words do not go to the reader of tables; all pages do where one has them."""
    texts = {("t", 1): "QTY PRICE AMOUNT x", ("t", 2): "no titles here x", ("p", 1): "PRICE AMOUNT only two", ("p", 2): "QTY and no more"}
    words = [(doc, page, i, text, 100.0 * i, 0.0, 50.0, 20.0, 1.0) for (doc, page), line in texts.items() for i, text in enumerate(line.split(" "))]
    seen = []

    def spy(words):
        seen.extend(words.select("doc", "page").distinct().collect())
        raise InterruptedError

    monkeypatch.setattr(column_tables, "read_tables", spy)
    for unsound in ([], [("t", 1, 9, "thin", 900.0, 0.0, 0.0, 20.0, 1.0), ("p", 1, 10, " ", 0.0, 0.0, 1.0, 1.0, 1.0)]):
        seen.clear()
        try:
            reading.read_all(spark.createDataFrame(words + unsound, WORDS))
        except InterruptedError:
            pass
        assert sorted(map(tuple, seen)) == [("t", 1), ("t", 2)]


def test_titles_are_cleaned_once(spark):
    """F1: the patterns that clean a title stand once in the plan, not in every filter and score that names it."""
    words = spark.createDataFrame([("d", 1, 1, "* WEEKLYINVOICE", 0.0, 0.0, 9.0, 30.0, 1.0), ("d", 2, 1, "Account", 0.0, 0.0, 9.0, 30.0, 1.0)], WORDS)
    titles = tables.page_titles(words)
    assert plan(titles).count("$1WEEKLY INVOICE") == 1
    assert [tuple(r) for r in titles.collect()] == [("d", 1, "WEEKLY INVOICE")]


def test_words_like_count_titles_pass_the_first_search(spark):
    """LIKELY lets through all that looks like a title, whatever stands around it."""
    texts = ["Int", "iNT.", "(Rec)", "Aet", "S\u0130t", "x|Int", "Gane", "NAME:", "Name\n", "I\nt", "GAME", "Into", "123", "", "Nome!", "In", "nt"]
    token = T.strip_edges(F.col("t"))
    like = F.greatest(*[T.looks_like(token, t) for t in (*inventories.TITLES, "Game", "Name")])
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", like.alias("like"), F.col("t").rlike(inventories.LIKELY).alias("likely")).collect()
    assert [r.t for r in rows if r.like and not r.likely] == [] and {r.t for r in rows if not r.likely} >= {"Into", "123", "", "In", "nt"}


def test_edged_numbers_and_totals(spark):
    texts = ["123", "(123)", "#123.", "1234", "12", "a123", "123\n", "TOTALS:", "-totals", "Total", "xTotals", "1.2.3", "..", "", "Totals 1"]
    token = T.strip_edges(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", token.rlike(inventories.GAME).alias("g"), F.col("t").rlike(inventories.EDGED_GAME).alias("eg"), T.is_totals(token).alias("o"), F.col("t").rlike(inventories.EDGED_TOTALS).alias("eo")).collect()
    assert [r.t for r in rows if r.g != r.eg or r.o != r.eo] == [] and sum(r.g for r in rows) == 4 and sum(r.o for r in rows) == 2


def test_dates_level_with_a_pack_are_paired(spark):
    """dates on a pack's level are paired without the pitch; those beside no pack are judged as before."""
    rows = [("d", 1, i, 0.0, 30.0 * i, 10.0, 20.0, f"00{i}-0000001", None) for i in range(4)] + [("d", 1, 10 + i, 500.0, 30.0 * i + (1.0 if i == 2 else 0.0), 80.0, 20.0, None, "01/01/98") for i in range(5)]
    words = spark.createDataFrame(rows, "doc string, page int, word_id long, x double, y double, width double, height double, pack string, date string")
    assert {r.word_id for r in with_lone_dates(words).where("lone").collect()} == {14}


def test_guards_of_packs_and_dates(spark):
    """what has no hyphen is no pack, what has not six digits is no date."""
    texts = ["123-0000001", ",12S-OO00001:", "0123", "GAME", "01/02/98", "01 02 98", "1102981", "12x02x1998", "1/2/98", "", "Settled:", "a-b"]
    packed = T.pack_token(F.col("t")).rlike("^[0-9]{3}-[0-9]{5,8}$")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", packed.alias("p"), T.settled_date(F.col("t")).alias("d"), F.contains("t", F.lit(T.PACKED)).alias("mp"), F.col("t").rlike(T.DATED).alias("md")).collect()
    assert all((r.mp or not r.p) and (r.md or r.d is None) for r in rows) and sum(r.p for r in rows) == 2 and sum(r.d is not None for r in rows) == 4
