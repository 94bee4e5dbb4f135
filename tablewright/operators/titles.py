"""Titles of columns: what scores as a title line, how stacked words join, which title a field is set under.

Columns over arrays of words (struct of text, x, y, width, height) or of labels; a title
line is a few words, so folds stay short. Spans are (x, right).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.functions.arrays import at, let, round_half_up

from .geometry import PAGE, union_spans

# Titles by kind of page.
HEADERS = {"inventory": ("Game", "Name", "Int", "Rec", "Act", "Set"), "settlements": ("Game-Pack", "Name", "Date Settled"), "invoice": ("label", "value")}
# Words that raise a title line's score.
KEYWORDS = r"(?i)\b(?:qty|quantity|description|name|unit|price|amount|total|date|item|code|number|pack|cost|order|upc|sku|part|extended|prc|case)\b"


# What no line of titles holds (figures alone, addresses, telephone numbers), and what makes one less likely (documents' names, long numbers).
FIGURES, ADDRESS, TELEPHONE = r"^\$?[\d.,]+%?$", r"https?://|www\.|\.com\b|@", r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b"
DOCUMENTS, LONG_NUMBER = r"(?i)\b(?:invoice|statement|receipt|summary|report)\b", r"\d{3,}[-/]\d{3,}"


def default_headers(kind: Column) -> Column:
    """The titles of a kind of page that prints none."""
    out = F.array(F.lit("Column"))
    for name, titles in HEADERS.items():
        out = F.when(kind == name, F.array(*map(F.lit, titles))).otherwise(out)
    return out


def lottery_titles(headers: Column) -> Column:
    """Whether titles are those of an inventory or of settlements."""
    flat = F.transform(headers, T.flat)
    has = lambda *ps: F.forall(F.array(*map(F.lit, ps)), lambda p: F.exists(flat, lambda h: F.regexp_like(h, p)))
    return has("^games?$", "^name$", "^int", "^rec", "^act", "^set") | ((has("gamepack") | has("^game$", "pack")) & (has("settled") | has("^date$")))


def usable_guide(headers: Column, bounds: Column) -> Column:
    """Whether another page's titles and edges can be read under."""
    return F.coalesce((F.size(headers) >= 3) & (F.size(headers) == F.size(bounds)), F.lit(False))


def printed_label(token: Column, target: str) -> Column:
    """The printed spelling where it is the title but for a letter, else the title."""
    return F.when(T.looks_like(token, target), token).otherwise(target)


def _count(labels: Column, test) -> Column:
    return F.size(F.filter(labels, test))


def header_score(labels: Column, following: Column, line: Column) -> Column:
    """How much a line of labels looks like titles, given the words of the line below (or null) and its place on the page."""
    n, joined = F.size(labels), F.array_join(labels, " ")
    textual = F.filter(labels, lambda c: c.rlike("[A-Za-z]") & ~c.rlike(r"^\d"))
    n_text = F.size(textual)
    upper = _count(textual, lambda c: (c == F.upper(c)) & c.rlike("[A-Z]"))
    keywords = F.regexp_count(joined, F.lit(KEYWORDS))
    below = F.filter(F.transform(following, lambda c: F.trim(c)), lambda c: c != "")
    numeric = _count(below, lambda c: c.rlike(r"\d"))
    score = (
        F.lit(18.0) * n_text / n + F.when(n >= 6, 34).when(n >= 4, 28).otherwise(16) + F.when(upper >= n_text * 0.5, 12).otherwise(0)
        + F.when(keywords >= 3, 26).when(keywords == 2, 16).when(keywords == 1, 8).otherwise(0) + F.when(line.between(2, 24), 4).otherwise(0)
        + F.when((F.size(following) < 2) | (numeric < 2) | following.isNull(), 0).when(F.exists(below, lambda c: c.rlike("[A-Za-z]")), 18).otherwise(12)
        - F.when((n <= 3) & joined.rlike(DOCUMENTS), 24).otherwise(0)
        - F.when((F.length(joined) > 140) & (n <= 3), 12).otherwise(0) - F.when(F.exists(labels, lambda c: c.rlike(LONG_NUMBER)), 30).otherwise(0)
    )
    out = F.forall(labels, lambda c: c.rlike(FIGURES)) | joined.rlike(ADDRESS) | joined.rlike(TELEPHONE) | (n_text < n * 0.6)
    return F.when((n == 0) | out, 0.0).otherwise(score)


def _centre(w: Column) -> Column:
    return w["y"] + w["height"] / 2


def one_baseline(words: Column, height: Column) -> Column:
    """Whether the words' middles lie within 0.4 of a line's height."""
    at = F.transform(words, _centre)
    return F.array_max(at) - F.array_min(at) <= height * 0.4


def _in_order(words: Column, *keys: str) -> Column:
    rest = [c for c in ("x", "y", "text", "width", "height") if c not in keys]
    return F.array_sort(F.transform(words, lambda w: F.struct(*(w[c].alias(c) for c in (*keys, *rest)))))


def joined_label(words: Column) -> Column:
    """Stacked title words as one label: line by line, repeated words once, nothing between a hyphen or slash and its neighbour."""
    rows = "array<struct<y: double, height: double, ws: array<struct<x: double, text: string>>>>"

    def lay(acc: Column, w: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = F.coalesce(F.abs(_centre(w) - last["y"]) <= last["height"] * 0.4, F.lit(False))
        one = F.array(F.struct(w["x"].alias("x"), w["text"].alias("text")))
        grown = F.struct(last["y"].alias("y"), last["height"].alias("height"), F.concat(last["ws"], one).alias("ws"))
        new = F.struct(_centre(w).alias("y"), w["height"].alias("height"), one.alias("ws"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(new))).cast(rows)

    lines = F.aggregate(_in_order(words, "y", "x"), F.array().cast(rows), lay)
    texts = F.transform(F.flatten(F.transform(lines, lambda r: F.array_sort(r["ws"]))), lambda w: T.squeeze(w["text"]))

    def say(acc: Column, t: Column) -> Column:
        glue = acc.rlike("[-/]$") | t.startswith("-")
        return F.when((t == "") | F.array_contains(F.split(acc, " "), t), acc).when(acc == "", t).when(glue, F.concat(acc, t)).otherwise(F.concat(acc, F.lit(" "), t))

    return F.aggregate(texts, F.lit(""), say)


def stacked_titles(words: Column, height: Column) -> Column:
    """Title words grouped into stacks: words of different baselines that overlap by 35 % of the narrower, and what hangs on them.

    A fold: each word joins together all stacks that it touches, which is the transitive
    closure. array of arrays of words, by left edge.
    """
    def touches(a: Column, b: Column) -> Column:
        shared = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
        return (F.abs(_centre(a) - _centre(b)) > height * 0.4) & (shared > 0) & (shared >= F.least(a["width"], b["width"]) * 0.35)

    def add(acc: Column, w: Column) -> Column:
        met = F.filter(acc, lambda s: F.exists(s, lambda o: touches(o, w)))
        apart = F.filter(acc, lambda s: ~F.exists(s, lambda o: touches(o, w)))
        return F.concat(apart, F.array(F.concat(F.flatten(met), F.array(w))))

    ordered = _in_order(F.filter(words, lambda w: F.trim(w["text"]) != ""), "x", "y")
    kind = "array<array<struct<x: double, y: double, text: string, width: double, height: double>>>"
    return F.array_sort(F.transform(F.aggregate(ordered, F.array().cast(kind), lambda a, w: add(a, w).cast(kind)), lambda s: F.array_sort(s)))


def both_carry_values(left: Column, right: Column, below: Column, height: Column) -> Column:
    """Whether two lines below, or more, fill both of two spans with words of their own, and no word straddles the gap between."""
    gutter = (left["right"] + right["x"]) / 2
    inked = F.filter(below, lambda w: F.trim(w["text"]) != "")
    straddles = F.exists(inked, lambda w: (w["x"] < gutter - 1) & (w["x"] + w["width"] > gutter + 1))
    line = lambda w: round_half_up(_centre(w) / F.greatest(height * 0.8, F.lit(1.0)))
    under = lambda w, span: sits_under(w["x"], w["x"] + w["width"], span)
    one = F.transform(F.filter(inked, lambda w: under(w, left) & ~under(w, right)), line)
    two = F.transform(F.filter(inked, lambda w: under(w, right) & ~under(w, left)), line)
    return ~straddles & (F.size(F.array_intersect(one, two)) >= 2)


def split_by_body(stacks: Column, below: Column, height: Column) -> Column:
    """A run of stacks parted wherever the lines below fill both sides, widest gap first, the parts parted again: an array of runs."""
    word = "struct<x: double, y: double, text: string, width: double, height: double>"
    span = lambda ws: F.struct(F.array_min(F.transform(ws, lambda w: w["x"])).alias("x"), F.array_max(F.transform(ws, lambda w: w["x"] + w["width"])).alias("right"))

    def part(run: Column) -> Column:
        def cut(i: Column) -> Column:
            return let(F.struct(span(F.flatten(F.slice(run, 1, i))).alias("l"), span(F.flatten(F.slice(run, i + 1, F.size(run)))).alias("r"), span(at(run, i)).alias("own")), lambda s: F.struct(
                (s["l"]["right"] - s["own"]["x"]).alias("minus_gap"), i.alias("i"), both_carry_values(s["l"], s["r"], below, height).alias("carries")))

        good = F.array_sort(F.filter(F.transform(F.sequence(F.lit(1), F.size(run) - 1), cut), lambda c: c["carries"]))
        return let(at(good, 0)["i"], lambda i: F.when(i.isNull(), F.array(run)).otherwise(F.array(F.slice(run, 1, i), F.slice(run, i + 1, F.size(run)))))

    kind = f"array<array<array<{word}>>>"
    parted = F.aggregate(F.sequence(F.lit(2), F.size(stacks)), F.array(stacks).cast(kind), lambda acc, _: F.flatten(F.transform(acc, lambda r: F.when(F.size(r) < 2, F.array(r)).otherwise(part(r)))).cast(kind))
    return F.when((F.size(stacks) < 2) | (F.size(below) == 0), F.array(stacks).cast(kind)).otherwise(parted)


STACK = "array<struct<x: double, y: double, text: string, width: double, height: double>>"


def beside(stacks: Column, height: Column) -> Column:
    """Runs of stacks: neighbours on one baseline at most 0.7 of the height apart, a wrapped title alone."""
    right = lambda ws: F.array_max(F.transform(ws, lambda w: w["x"] + w["width"]))
    left = lambda ws: F.array_min(F.transform(ws, lambda w: w["x"]))

    def add(acc: Column, s: Column) -> Column:
        def joined(last: Column) -> Column:
            ws = F.flatten(last)
            gap = left(s) - right(ws)
            joins = F.coalesce(one_baseline(ws, height) & one_baseline(s, height) & (gap > 0) & (gap <= height * 0.7), F.lit(False))
            grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.array(s))))
            return F.when(joins, grown).otherwise(F.concat(acc, F.array(F.array(s)))).cast(f"array<array<{STACK}>>")

        return let(F.try_element_at(acc, F.lit(-1)), joined)

    return F.aggregate(stacks, F.array().cast(f"array<array<{STACK}>>"), add)


def named(runs: Column) -> Column:
    """(x, right, label) of each run of stacks that says anything."""
    made = F.transform(F.transform(runs, F.flatten), lambda g: F.struct(
        F.array_min(F.transform(g, lambda w: w["x"])).alias("x"), F.array_max(F.transform(g, lambda w: w["x"] + w["width"])).alias("right"), joined_label(g).alias("label")))
    return F.filter(made, lambda c: c["label"] != "")


def title_columns(words: Column, height: Column) -> Column:
    """(x, right, label) of each column title: stacks, and neighbours on one baseline at most 0.7 of the height apart."""
    return named(beside(stacked_titles(words, height), height))


def label_tokens(words: Column) -> Column:
    """Labels of a title line: parted at gaps of 1.8 of the middle gap (the upper of two) or 0.4 of the mean height."""
    ordered = _in_order(F.filter(words, lambda w: F.trim(w["text"]) != ""), "x")
    n = F.size(ordered)
    gaps = F.transform(ordered, lambda w, i: F.when(i > 0, F.greatest(F.lit(0.0), w["x"] - F.try_element_at(ordered, i)["x"] - F.try_element_at(ordered, i)["width"])))
    known = F.array_sort(F.filter(gaps, lambda g: g.isNotNull()))
    middle = F.try_element_at(known, (F.floor(F.size(known) / 2) + 1).cast("int"))
    height = F.aggregate(ordered, F.lit(0.0), lambda a, w: a + w["height"]) / n
    far = F.greatest(middle * 1.8, height * 0.4)
    parts = F.zip_with(ordered, gaps, lambda w, g: F.struct(F.trim(w["text"]).alias("text"), F.coalesce(g >= far, F.lit(False)).alias("far")))

    def say(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        glue = F.when(p["text"].startswith("-") | last.endswith("-"), "").otherwise(" ")
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, glue, p["text"])))
        return F.when((F.size(acc) > 0) & ~p["far"], grown).otherwise(F.concat(acc, F.array(p["text"])))

    return F.aggregate(parts, F.array().cast("array<string>"), say)


def split_labels(words: Column, starts: Column) -> Column:
    """Labels of a title line: words that start in one of the columns whose left edges the rows below repeat.

    A word may stand half of the mean height before its edge. With under two edges the line
    is parted at its gaps instead. Nothing stands between a hyphen and its neighbour.
    """
    kind = "array<struct<column: int, text: string>>"
    ordered = _in_order(F.filter(words, lambda w: F.trim(w["text"]) != ""), "x")
    slack = F.aggregate(ordered, F.lit(0.0), lambda a, w: a + w["height"]) / F.greatest(F.size(ordered), F.lit(1)) * 0.5
    placed = F.transform(ordered, lambda w: F.struct(start_index(w["x"], starts, slack).cast("int").alias("column"), F.trim(w["text"]).alias("text")))

    def put(acc: Column, w: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        glue = F.when(w["text"].startswith("-") | last["text"].endswith("-"), "").otherwise(" ")
        grown = F.struct(last["column"].alias("column"), F.concat(last["text"], glue, w["text"]).alias("text"))
        return F.when(F.coalesce(last["column"] == w["column"], F.lit(False)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(w))).cast(kind)

    labels = F.transform(F.aggregate(placed, F.array().cast(kind), put), lambda g: g["text"])
    return F.when(F.size(starts) >= 2, labels).otherwise(label_tokens(words))


def start_index(x: Column, starts: Column, slack: Column) -> Column:
    """The last of ``starts`` at or before x and a slack, the first if none is."""
    return F.coalesce(F.array_max(F.filter(F.transform(starts, lambda s, i: F.when(s <= x + slack, i)), lambda i: i.isNotNull())), F.lit(0))


def sits_under(x: Column, right: Column, title: Column) -> Column:
    """Whether a word overlaps a title's span by 30 % of the narrower of both."""
    shared = F.least(right, title["right"]) - F.greatest(x, title["x"])
    return (shared > 0) & (shared >= F.least(right - x, title["right"] - title["x"]) * 0.3)


def starts_in_column(x: Column, bounds: Column, index: Column, slack: Column) -> Column:
    """Whether a field begins in a column rather than reaching into it."""
    low, high = F.try_element_at(bounds, index + 1), F.try_element_at(bounds, index + 2)
    return F.coalesce(x >= low - slack, F.lit(True)) & F.coalesce(x < high, F.lit(True))


def title_of(x: Column, right: Column, titles: Column) -> Column:
    """The one title that a span overlaps by half of the narrower, -1 for none or several."""
    def hit(t: Column, i: Column) -> Column:
        shared = F.least(right, t["right"]) - F.greatest(x, t["x"])
        return F.when((shared > 0) & (shared >= F.least(right - x, t["right"] - t["x"]) * 0.5), i)

    hits = F.filter(F.transform(titles, hit), lambda i: i.isNotNull())
    return F.when(F.size(hits) == 1, F.try_element_at(hits, F.lit(1))).otherwise(-1)


def gutter_bounds(body: DataFrame, columns: DataFrame) -> DataFrame:
    """(doc, page, col, bound): each column's edge, in the middle of the widest gap of the body between its title and the one before.

    body: (doc, page, lo, hi); columns: (doc, page, col, x, right, printed, height). The
    printed edge stays where no gap is half a line high. The widest gap wins, of equals the first.
    """
    order = W.partitionBy(*PAGE).orderBy("lo")
    inked = union_spans(body, PAGE)
    free = inked.select(*PAGE, F.lag("hi").over(order).alias("gap_lo"), F.col("lo").alias("gap_hi")).where("gap_lo IS NOT NULL")
    reach = columns.withColumn("before", F.lag("x").over(W.partitionBy(*PAGE).orderBy("col")))
    lo, hi = F.greatest("gap_lo", "before"), F.least("gap_hi", "right")
    met = reach.where("before IS NOT NULL").join(free, PAGE).where(hi > lo).select(*PAGE, "col", lo.alias("lo"), hi.alias("hi"))
    best = met.groupBy(*PAGE, "col").agg(F.max_by(F.struct("lo", "hi"), F.struct(F.col("hi") - F.col("lo"), -F.col("lo"))).alias("g"))
    wide = (F.col("g.hi") - F.col("g.lo")) >= F.col("height") * 0.5
    return reach.join(best, [*PAGE, "col"], "left").select(*PAGE, "col", F.when(wide, (F.col("g.lo") + F.col("g.hi")) / 2).otherwise(F.col("printed")).alias("bound"))
