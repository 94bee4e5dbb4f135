"""Finding printed titles among a page's words: hits of title words, bands, stacked lines above, a score.

A page is a row with its words (array of struct<x, y, text, width, height>); steps are
projections of such rows, candidates are rows beside each other, so after words meet by
page nothing is shuffled but the few headers found.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.arrays import at, indexes, largest, least, let, median
from tablewright.sources.rest import at_rest

from .geometry import PAGE
from .tables import TITLES
from .titles import beside, header_score, named, split_by_body, stacked_titles

WORD = "struct<x: double, y: double, text: string, width: double, height: double>"
#: Parts of words that title a column, the score a line of titles needs, titles a table has.
HINTS, LEAST_SCORE, LEAST_COLUMNS, MOST_TABLES = "(?i)upc|part#|description", 28, 3, 8
AMOUNT = r"^\$?[0-9,]*[0-9]\.[0-9]{2}$"


def right(w: Column) -> Column:
    return w["x"] + w["width"]


def bottom(w: Column) -> Column:
    return w["y"] + w["height"]


def middle(w: Column) -> Column:
    return w["y"] + w["height"] / 2


def title_word(text: Column | str = "text") -> Column:
    """Whether a word is of the title vocabulary; a page that has titles has LEAST_COLUMNS of them."""
    text = F.col(text) if isinstance(text, str) else text
    return F.trim(text).rlike(TITLES) | text.rlike(HINTS)


def _stacks_over(line: Column, columns: Column) -> Column:
    """Whether each word of a line overlaps exactly one title by 35 % of the narrower, no title twice."""
    def over(w: Column) -> Column:
        def meets(c: Column, _: Column) -> Column:
            shared = F.least(right(w), c["right"]) - F.greatest(w["x"], c["x"])
            return (shared > 0) & (shared >= F.least(w["width"], c["right"] - c["x"]) * 0.35)

        return indexes(columns, meets)

    met = F.transform(line, over)
    single = F.forall(met, lambda m: F.size(m) == 1) & (F.size(F.array_distinct(F.flatten(met))) == F.size(line))
    return (F.size(line) > 0) & (F.size(line) <= F.size(columns)) & single


def with_titles(df: DataFrame, words: str, below: str, out: str) -> DataFrame:
    """``df`` with ``out``: the columns that the title words of an array column make, parted by the words below them."""
    height = median(F.transform(words, lambda w: w["height"]))
    df = df.withColumn("_h", F.when(height == 0, 12.0).otherwise(height))
    df = df.withColumn("_s", let(F.col("_h"), lambda h: stacked_titles(F.col(words), h)))
    df = df.withColumn("_g", let(F.col("_h"), lambda h: beside(F.col("_s"), h)))
    df = df.withColumn("_p", let(F.struct("_h", F.col(below).alias("b")), lambda k: F.flatten(F.transform("_g", lambda g: split_by_body(g, k["b"], k["_h"])))))
    return df.withColumn(out, named(F.col("_p"))).drop("_h", "_s", "_g", "_p")


def _line_above(words: Column, titles: Column, height: Column) -> Column:
    """The printed line directly above title words, by the nearest baseline."""
    above = let(least(titles, lambda w: w["y"]), lambda y: F.filter(words, lambda w: middle(w) < y))
    return let(F.struct(above.alias("a"), height.alias("h")), lambda k: let(largest(k["a"], middle), lambda m: F.filter(k["a"], lambda w: F.abs(middle(w) - m) <= k["h"] * 0.5)))


def find_header(pages: DataFrame, topmost: bool = False) -> DataFrame:
    """(doc, page, columns, titles, top, bottom) of pages (doc, page, words) whose words hold titles.

    Hits are words of the title vocabulary; around each, the hits within 1.3 heights are a
    group, whose band holds the title words. The largest group that reads as titles
    wins, or the topmost if so asked, of equals the one met first in reading order.
    """
    inked = F.array_sort(F.transform(F.filter("words", lambda w: F.trim(w["text"]) != ""), lambda w: F.struct(middle(w).alias("m"), w["x"].alias("x"), w.alias("w"))))
    df = pages.select(*PAGE, F.transform(inked, lambda o: o["w"]).alias("words"))
    df = df.withColumn("hits", F.filter("words", lambda w: title_word(w["text"]))).where(F.size("hits") >= LEAST_COLUMNS)
    height = median(F.transform("hits", lambda w: w["height"]))
    df = df.withColumn("height", F.when(height == 0, 12.0).otherwise(height))
    groups = let(F.struct("hits", "height"), lambda k: F.transform(k["hits"], lambda a: F.filter(k["hits"], lambda w: F.abs(middle(w) - middle(a)) <= k["height"] * 1.3)))
    df = df.select(*PAGE, "words", "height", F.posexplode(F.array_distinct(F.filter(groups, lambda g: F.size(g) >= LEAST_COLUMNS))).alias("i", "group"))
    df = df.withColumn("first", least(F.col("group"), lambda w: w["y"])).withColumn("bottom", largest(F.col("group"), bottom))
    order = F.struct(F.col("first") if topmost else F.lit(0.0), -F.size("group"), "i").alias("order")
    edges = F.struct("first", "bottom", "height")
    df = df.select(*PAGE, "words", "height", "bottom", order, let(edges, lambda k: F.filter("words", lambda w: (middle(w) >= k["first"] - k["height"] * 0.35) & (middle(w) <= k["bottom"] + k["height"] * 0.35))).alias("titles"))
    df = df.where(~F.exists("titles", lambda w: F.trim(w["text"]).rlike(AMOUNT)))
    below = lambda most: let(F.struct("bottom", "height"), lambda k: F.filter("words", lambda w: (w["y"] > k["bottom"]) & (w["y"] < k["bottom"] + k["height"] * most)))
    df = df.withColumn("body", below(14)).withColumn("near", F.transform(below(3), lambda w: w["text"]))
    # a group with no, one and two lines above taken in; the columns of each show whether the next line stacks over them
    df = df.withColumn("l1", _line_above(F.col("words"), F.col("titles"), F.col("height"))).withColumn("t1", F.concat("titles", "l1"))
    df = df.withColumn("l2", _line_above(F.col("words"), F.col("t1"), F.col("height")))
    tries = F.array(F.struct("titles", F.array().cast(f"array<{WORD}>").alias("line")), F.struct(F.col("t1").alias("titles"), F.col("l1").alias("line")), F.struct(F.concat("t1", "l2").alias("titles"), F.col("l2").alias("line")))
    df = df.select(*PAGE, "order", "bottom", "body", "near", F.posexplode(tries).alias("climb", "v")).select(*PAGE, "order", "bottom", "body", "near", "climb", "v.titles", "v.line")
    df = with_titles(df.where((F.col("climb") == 0) | (F.size("line") > 0)), "titles", "body", "columns").drop("body")
    up = Window.partitionBy(*PAGE, "order").orderBy("climb")
    under = F.lag("columns").over(up)
    df = df.withColumn("fits", F.when(F.col("climb") == 0, F.size("columns") >= LEAST_COLUMNS).otherwise(F.coalesce((F.size(under) >= LEAST_COLUMNS) & _stacks_over(F.col("line"), under), F.lit(False))))
    df = df.withColumn("fits", F.min("fits").over(up.rowsBetween(Window.unboundedPreceding, 0))).where("fits")
    best = df.groupBy(*PAGE, "order").agg(F.max_by(F.struct("columns", "titles", "bottom", "near"), "climb").alias("h")).select(*PAGE, "order", "h.*")
    best = best.where((F.size("columns") >= LEAST_COLUMNS) & (header_score(F.transform("columns", lambda c: c["label"]), F.col("near"), F.lit(4)) >= LEAST_SCORE))
    return best.groupBy(*PAGE).agg(F.min_by(F.struct("columns", "titles", least(F.col("titles"), lambda w: w["y"]).alias("top"), "bottom"), "order").alias("h")).select(*PAGE, "h.*")


def find_headers(pages: DataFrame) -> DataFrame:
    """(doc, page, nth, columns, titles, top, bottom): all headers of pages (doc, page, line_height, words), from 0 downwards.

    Each next one is the topmost among the words below the last; rounds end when no page has
    a further one, after eight at most. Each round works on the pages of the last one alone.
    """
    found = at_rest(find_header(pages).withColumn("nth", F.lit(0)))
    rounds = [found]
    while len(rounds) < MOST_TABLES and not found.isEmpty():
        last = found.select(*PAGE, F.struct("top", "bottom").alias("last"))
        rest = let(F.col("last.bottom") + F.col("line_height") * 0.5, lambda y: F.filter("words", lambda w: w["y"] > y))
        below = pages.join(last, PAGE).select(*PAGE, "last", rest.alias("words"))
        further = find_header(below, True).join(last, PAGE).where(F.col("top") > F.col("last.top")).drop("last")
        found = at_rest(further.withColumn("nth", F.lit(len(rounds))))
        rounds.append(found)
    return functools.reduce(DataFrame.unionByName, rounds)


def column_bounds(columns: Column) -> Column:
    """Printed left edges: the first at most 4 left of its title; the others a pixel left of theirs, or on the
    shoulder of the title before where the gap is wider than 1.5 of it."""
    def edge(c: Column, i: Column) -> Column:
        before = at(columns, i - 1)
        reach = F.least(before["right"], c["x"] - 1)  # a trailing space can make a title's box reach into the next
        width = F.greatest(F.lit(1.0), before["right"] - before["x"])
        gap = c["x"] - reach
        shoulder = reach + F.least(gap * 0.22, width * 0.45)
        return F.when(i == 0, F.least(F.lit(0.0), c["x"] - 4)).when(gap > width * 1.5, shoulder).otherwise(c["x"] - 1)

    return F.transform(columns, edge)
