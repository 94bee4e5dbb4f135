"""Inventory rows by anchors: words go to the game number or TOTALS that they stand by, whatever their line.

A page's titles are found in order, its anchors stand in one column, words join the nearest anchor (a range
join by cells), and the four counts are read under columns fitted to the page's own
counts. Pages without anchors, and pages whose columns cannot be placed, are read row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.functions.arrays import at, let, once
from tablewright.sources.rest import at_rest, dealt

from .geometry import PAGE, assign_rows, group_lines
from .words import count_parts

TITLES = ("Int", "Rec", "Act", "Set")
# Fixed value: a game number; the same and TOTALS between marks.
GAME = "^[0-9]{3}$"
EDGED_GAME, EDGED_TOTALS = "^[^A-Za-z0-9]*[0-9]{3}[^A-Za-z0-9]*$", "(?i)^[^A-Za-z0-9]*totals[^A-Za-z0-9]*$"
#: What any word that looks like a title, or like Game or Name, is in its letters; told by one search, before letters are counted.
LIKELY = "(?is)^[^A-Za-z0-9]*(?:" + "|".join(t[:i] + "." + t[i + 1:] for t in (*TITLES, "Game", "Name") for i in range(len(t))) + ")[^A-Za-z0-9]*$"
WORD = "array<struct<x: double, y: double, word_id: bigint, width: double, text: string, confidence: double>>"


def count_titles(lines: DataFrame) -> DataFrame:
    """(doc, page, own, top, bottom, centres) of each page's first line with the four titles in order.

    A title may differ in one letter; two of the four must be exact. ``own`` holds the word ids
    of the titles and of Game and Name left of them. The next title is sought from where the
    last was found, so a fold over the line's words that look like titles.
    """
    token = T.strip_edges(F.col("text"))
    like = F.array(*[T.looks_like(token, t) for t in TITLES])
    exact = F.array(*[F.lower(token) == t.lower() for t in TITLES])
    named = F.array(T.looks_like(token, "Game"), T.looks_like(token, "Name"))
    word = F.struct("x", "word_id", (F.col("x") + F.col("width") / 2).alias("centre"), "y", (F.col("y") + F.col("height")).alias("bottom"), like.alias("like"), exact.alias("exact"), named.alias("named"))
    sized = F.length(token).isin(*{len(t) for t in (*TITLES, "Game", "Name")})  # a title differs in no length
    likely = lines.where(F.col("text").rlike(LIKELY) & sized & (F.array_contains(like, True) | F.array_contains(named, True)))
    rows = likely.groupBy(*PAGE, "line_id").agg(F.sort_array(F.collect_list(word)).alias("words")).where(F.size("words") >= len(TITLES))

    def take(found: Column, w: Column) -> Column:
        n = F.size(found)
        return F.when((n < len(TITLES)) & F.coalesce(at(w["like"], n), F.lit(False)), F.concat(found, F.array(w))).otherwise(found)

    kind = rows.schema["words"].dataType.simpleString()
    rows = rows.withColumn("counts", F.aggregate("words", F.array().cast(kind), take)).where(F.size("counts") == len(TITLES))
    rows = rows.where(F.size(F.filter(F.transform("counts", lambda w, i: at(w["exact"], i)), lambda e: e)) >= 2)
    left = F.filter("words", lambda w: w["x"] < at(F.col("counts"), 0)["x"])
    game = F.slice(F.filter(left, lambda w: at(w["named"], 0)), 1, 1)
    name = F.slice(F.filter(left, lambda w: at(w["named"], 1) & ~F.array_contains(F.transform(game, lambda g: g["word_id"]), w["word_id"])), 1, 1)
    heads = rows.withColumn("own", F.concat("counts", game, name)).groupBy(*PAGE).agg(F.min_by(F.struct("own", "counts"), "line_id").alias("h"))
    part = lambda c, f: F.transform(c, lambda w: w[f])
    own, counts = F.col("h.own"), F.col("h.counts")
    return heads.select(*PAGE, part(own, "word_id").alias("own"), F.array_min(part(own, "y")).alias("top"), F.array_max(part(own, "bottom")).alias("bottom"), part(counts, "centre").alias("centres"))


def tight_run(words: Column) -> Column:
    """Four neighbouring counts struct<text, x, centre, of> of sorted words that lie closest, the first such run; null for fewer.

    Glued counts count one by one; ``of`` is the word's index, -1 for a part of a glued one.
    """

    def parts(w: Column, i: Column) -> Column:
        texts = count_parts(w["text"])
        width = w["width"] / F.size(texts)
        place = lambda t, k: F.struct(T.count_value(t).alias("text"), (w["x"] + width * k).alias("x"), (w["x"] + width * (k + 0.5)).alias("centre"), F.when(F.size(texts) > 1, -1).otherwise(i).alias("of"))
        return F.transform(texts, place)

    counts = F.filter(F.flatten(F.transform(words, parts)), lambda c: c["text"].isNotNull())

    def closest(c: Column) -> Column:
        first = F.array_min(F.transform(F.sequence(F.lit(0), F.size(c) - 4), lambda i: F.struct((at(c, i + 3)["x"] - at(c, i)["x"]).alias("span"), i.alias("i"))))["i"]
        return F.slice(c, first + 1, 4)

    return let(counts, lambda c: F.when(F.size(c) >= 4, closest(c)))


def read_counts(words: Column, centres: Column, pitch: Column) -> Column:
    """Four counts of sorted words: each piece of three digits, short count or single digit goes to the nearest centre.

    A piece reaches three quarters of the pitch; of equally near centres the later takes it. A
    column with three digits is read, one short count is padded, anything else is empty.
    Twelve digits in all are four counts wherever they stand.
    """
    digits_of = lambda w: T.count_digits(F.trim(w["text"]))
    piece = lambda t, centre, short: F.struct(t.alias("text"), centre.cast("double").alias("centre"), F.lit(short).alias("short"))

    def pieces(w: Column) -> Column:
        def of(d: Column) -> Column:
            threes = F.transform(F.sequence(F.lit(0), F.floor(F.length(d) / 3).cast("int") - 1), lambda i: piece(F.substring(d, i * 3 + 1, F.lit(3)), w["x"] + w["width"] * (i + 0.5) / (F.length(d) / 3), False))
            text = F.trim(w["text"])
            chars = F.transform(F.sequence(F.lit(0), F.length(text) - 1), lambda i: piece(T.count_digits(F.substring(text, i + 1, F.lit(1))), w["x"] + w["width"] * (i + 0.5) / F.length(text), False))
            short = (F.length(d) < 3) & T.token_core(w["text"]).rlike("^[0-9]+$")
            return (
                F.when(d == "", F.array().cast("array<struct<text: string, centre: double, short: boolean>>"))
                .when(F.length(d) % 3 == 0, threes)
                .when(short, F.array(piece(d, w["x"] + w["width"] / 2, True)))
                .otherwise(F.filter(chars, lambda c: c["text"] != ""))
            )

        return let(digits_of(w), of)

    def column(p: Column) -> Column:
        ranked = F.transform(centres, lambda c, i: F.struct(F.abs(p["centre"] - c).alias("d"), (-i).alias("later")))
        return -F.array_min(F.filter(ranked, lambda r: r["d"] <= pitch * 0.75))["later"]

    def read(placed: Column, i: int) -> Column:
        def value(mine: Column) -> Column:
            text = F.array_join(F.transform(mine, lambda p: p["p"]["text"]), "")
            return F.when(F.length(text) == 3, text).when((F.size(mine) == 1) & F.coalesce(at(mine, 0)["p"]["short"], F.lit(False)), F.lpad(text, 3, "0")).otherwise("")

        return let(F.filter(placed, lambda p: p["col"] == i), value)

    spread = F.transform(F.flatten(F.transform(words, pieces)), lambda p: F.struct(p.alias("p"), column(p).alias("col")))
    by_place = let(spread, lambda placed: F.array(*[read(placed, i) for i in range(4)]))
    every = F.array_join(F.transform(words, digits_of), "")
    return let(every, lambda d: F.when(F.length(d) == 12, F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.substring(d, i * 3 + 1, F.lit(3)))).otherwise(by_place))


def joined(words: Column) -> Column:
    """The texts of sorted words; a credit mark and cents join the word before them."""
    texts = F.filter(F.transform(words, lambda w: F.trim(w["text"])), lambda t: t != "")
    glued = F.transform(texts, lambda t, i: F.when((i == 0) | T.is_credit_mark(t) | t.startswith("."), t).otherwise(F.concat(F.lit(" "), t)))
    return F.array_join(glued, "")


def mean_confidence(words: Column) -> Column:
    return F.aggregate(words, F.lit(0.0), lambda a, w: a + w["confidence"]) / F.greatest(F.size(words), F.lit(1))


def anchored_cells(anchor: Column, rest: Column, centres: Column, pitch: Column) -> Column:
    """The cells of a row of an anchor and its other words, sorted: counts by their place, the name between anchor and counts."""
    low, high = at(centres, 0) - pitch * 0.8, at(centres, 3) + pitch * 0.8
    centre = lambda w: w["x"] + w["width"] / 2
    counts = F.filter(rest, lambda w: centre(w).between(low, high))
    label = F.filter(rest, lambda w: (centre(w) < low) & (w["x"] >= anchor["x"] + anchor["width"] * 0.5))
    title = T.strip_edges(anchor["text"])
    total = T.is_totals(title)
    lead = F.array(F.when(total, "").otherwise(title), F.when(total, title).otherwise(T.repair_game_name(joined(label))))
    return F.concat(lead, read_counts(counts, centres, pitch))


def line_cells(words: Column) -> Column:
    """The cells of a row of sorted words alone, null if it is none: the closest four counts, before them a game number or TOTALS.

    Without a number, leading words of up to three characters are strays of the margin.
    """
    token = lambda w: T.strip_edges(w["text"])
    numbered = lambda w: token(w).rlike(GAME) | T.is_totals(token(w))

    def cells(run: Column) -> Column:
        mine = F.transform(run, lambda c: c["of"])
        label = F.filter(F.filter(words, lambda w, i: ~F.array_contains(mine, i)), lambda w: w["x"] < at(run, 0)["x"])

        def from_label(ws: Column) -> Column:
            start = F.array_min(F.filter(F.transform(ws, lambda w, i: F.when(numbered(w), i)), lambda i: i.isNotNull()))
            long = F.array_min(F.filter(F.transform(ws, lambda w, i: F.when(F.length(token(w)) > 3, i)), lambda i: i.isNotNull()))
            begin = F.coalesce(start, long, F.size(ws))
            body = F.slice(ws, begin + 1, F.size(ws))
            game = F.when(token(at(ws, begin)).rlike(GAME), token(at(ws, begin))).otherwise("")
            name = T.repair_game_name(joined(F.when(game != "", F.slice(body, 2, F.size(ws) + 1)).otherwise(body)))
            return F.when((F.size(body) > 0) & ((game != "") | T.is_totals(name)), F.concat(F.array(game, name), F.transform(run, lambda c: c["text"])))

        return let(label, from_label)

    return let(tight_run(words), lambda run: F.when(run.isNotNull(), cells(run)))


def may_count(text: Column) -> Column:
    """At most how many counts a word holds: four if it is nothing but threes of digits, one if it has one run of up to three, else none."""
    threes = text.rlike(r"^[^0-9A-Za-z]*[0-9]{3}(?:[^0-9A-Za-z]*[0-9]{3})+[^0-9A-Za-z]*$")
    return F.when(threes, 4).when(text.rlike("^[^0-9]*[0-9]{1,3}[^0-9]*$"), 1).otherwise(0)


def anchored_inventory(words: DataFrame, overlap: float = 0.5, rows: int | None = None, heads: DataFrame | None = None) -> DataFrame:
    """(doc, page, row, cells, confidence): Game, Name, Int, Rec, Act, Set, top to bottom; rows may slope or overlap.

    Anchors are TOTALS and numbers of three digits in the left 45 % of the page that stand near the median
    of such numbers, none below the last TOTALS. Words below the titles join the anchor
    that ``assign_rows`` gives. The columns are the medians of the rows' closest four counts if
    three rows have such, else the titles' centres. Blank words and words without extent are left out.
    ``rows``: how many words there are, where they lie at rest already; else they are put to rest and counted.
    ``heads``: their ``count_titles``, where known.
    """
    if rows is None:
        words = at_rest(words)
        rows = words.count()
    usable = dealt(words.where((F.trim("text") != "") & (F.col("width") > 0) & (F.col("height") > 0)), rows, *PAGE)
    heads = count_titles(group_lines(usable, 0.5)) if heads is None else dealt(heads, rows, *PAGE)
    body = usable.join(heads, PAGE, "left").where("top IS NULL OR (NOT array_contains(own, word_id) AND y + height > top)").drop("own", "top", "bottom").withColumnRenamed("centres", "titled")
    page = W.partitionBy(*PAGE)
    body = body.withColumns({"_right": F.max(F.col("x") + F.col("width")).over(page), "_at": F.col("y") + F.col("height") / 2, "_total": F.col("text").rlike(EDGED_TOTALS)})
    body = body.withColumn("_game", F.col("text").rlike(EDGED_GAME) & (F.col("x") <= 0.45 * F.col("_right")))
    column = lambda c: F.coalesce(F.median(F.when(F.col("_game"), F.col(c))).over(page), F.lit(0.0))
    body = body.withColumns({"_off": F.col("x") - column("x"), "_tall": F.greatest(column("height"), F.lit(1.0))})
    near = F.col("_off").between(-F.greatest(F.lit(48.0), F.col("_tall") * 3), F.greatest(F.lit(16.0), F.col("_tall")))
    last = F.max(F.when(F.col("_total"), F.col("_at"))).over(page)
    body = body.withColumn("_last", last).withColumn("_anchor", (F.col("_total") | (F.col("_game") & near)) & (F.col("_last").isNull() | (F.col("_at") <= F.col("_last"))))
    word = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("word_id").cast("long").alias("word_id"), F.col("width").cast("double").alias("width"), "text", F.col("confidence").cast("double").alias("confidence"))
    body = body.withColumns({"word": word, "_any": F.max(F.col("_anchor").cast("int")).over(page)})
    body = dealt(at_rest(body.select(*PAGE, "word", "height", "titled", "_at", "_anchor", "_any")), rows, *PAGE)

    order = W.partitionBy(*PAGE).orderBy("at", "x", "word_id")
    anchors = body.where("_anchor").select(*PAGE, "word.x", "word.word_id", "height", "titled", F.col("word").alias("anchor"), F.col("_at").alias("at")).withColumn("nth", F.row_number().over(order) - 1)
    anchors = dealt(at_rest(anchors), rows, *PAGE)  # few beside the words, and named by five steps
    items = body.where("_any = 1 AND NOT _anchor").select(*PAGE, F.col("word").alias("item"), F.col("_at").alias("at"))
    pitch = F.greatest(F.lit(24.0), F.median("height") * 1.6)
    taken = assign_rows(items, anchors, PAGE, pitch, overlap, 0.35 + overlap).select(*PAGE, "anchor", "item")
    alone = anchors.select(*PAGE, "anchor", "nth", "titled", F.lit(None).cast(taken.schema["item"].dataType).alias("item"))
    groups = dealt(alone.unionByName(taken, allowMissingColumns=True), rows, *PAGE).groupBy(*PAGE, "anchor").agg(F.max("nth").alias("nth"), F.first("titled", ignorenulls=True).alias("titled"), F.sort_array(F.collect_list("item")).cast(WORD).alias("rest"))
    groups = groups.withColumn("words", F.array_sort(F.concat("rest", F.array("anchor").cast(WORD))))

    groups = once(groups, run=F.transform(tight_run(F.col("words")), lambda c: c["centre"]))
    slots = F.array(*[F.median(at(F.col("run"), i)).over(page) for i in range(4)])
    groups = groups.withColumn("centres", F.when(F.count("run").over(page) >= 3, slots).otherwise(F.col("titled")))
    groups = groups.withColumn("pitch", (at(F.col("centres"), 3) - at(F.col("centres"), 0)) / 3)
    placed = anchored_cells(F.col("anchor"), F.col("rest"), F.col("centres"), F.col("pitch"))
    found = lambda cells: F.explode(F.filter(F.array(cells), lambda c: c.isNotNull())).alias("cells")
    by_anchor = groups.select(*PAGE, "nth", found(F.when(F.col("pitch") > 0, placed).otherwise(line_cells(F.col("words")))), mean_confidence(F.col("words")).alias("confidence"))

    # a line without four counts is no row; its words are not gathered
    lines = group_lines(body.where("_any = 0").select(*PAGE, "word.x", "word.y", "height", "word.word_id", "word"), overlap)
    counted = lines.withColumn("counts", F.sum(may_count(F.col("word.text"))).over(W.partitionBy(*PAGE, "line_id"))).where("counts >= 4")
    bare = counted.groupBy(*PAGE, F.col("line_id").alias("nth")).agg(F.sort_array(F.collect_list("word")).cast(WORD).alias("words"))
    by_line = bare.select(*PAGE, "nth", found(line_cells(F.col("words"))), mean_confidence(F.col("words")).alias("confidence"))
    return by_anchor.unionByName(by_line).select(*PAGE, (F.row_number().over(W.partitionBy(*PAGE).orderBy("nth")) - 1).alias("row"), "cells", "confidence")
