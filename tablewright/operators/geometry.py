"""Words to lines and fields, intervals, anchors: the geometry of a page as window plans.

Everything is partitioned by (doc, page), so a page is the largest group a task sees.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.functions.arrays import let, median

PAGE = ["doc", "page"]
#: The column of words whose lines are found.
LINED = "_lined"
BEFORE = (W.unboundedPreceding, -1)


def group_lines(words: DataFrame, overlap: float = 0.5) -> DataFrame:
    """Words with line_id (from 0, top to bottom) and nth (left to right).

    A word opens a line if it overlaps the lowest reaching word before it by less than
    ``overlap`` of the smaller of both heights. Exact for lines that do not interleave vertically; see group_lines_exact.
    Words marked as ``LINED`` stay in the lines that they are in.
    """
    if LINED in words.columns:
        return words
    order = W.partitionBy(*PAGE).orderBy(F.col("y") + F.col("height") / 2, "x", "word_id")
    reach = F.max(F.struct((F.col("y") + F.col("height")).alias("bottom"), "height")).over(order.rowsBetween(*BEFORE))
    shared = F.least(reach["bottom"], F.col("y") + F.col("height")) - F.col("y")
    opens = F.when(reach.isNull(), 1).otherwise((shared < overlap * F.least(F.col("height"), reach["height"])).cast("int"))
    lines = words.withColumn("_o", opens).withColumn("line_id", F.sum("_o").over(order.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("_o")
    return lines.withColumn("nth", F.row_number().over(W.partitionBy(*PAGE, "line_id").orderBy("x", "word_id")) - 1)


def group_lines_exact(words: DataFrame, overlap: float = 0.5, look_back: int = 4) -> DataFrame:
    """The same columns where lines may interleave: each word joins the best overlapping of the
    last lines, in order, which no window frame can express; a page is one group."""
    schema = words.drop("line_id", "nth").schema.add("line_id", "long").add("nth", "long")

    def lay(page: pd.DataFrame) -> pd.DataFrame:
        page = page.drop(columns=["line_id", "nth"], errors="ignore")
        page = page.assign(centre=page.y + page.height / 2).sort_values(["centre", "x", "word_id"], kind="stable").drop(columns="centre")
        bands: list[list[float]] = []
        of: list[int] = []
        for top, height in zip(page.y, page.height, strict=True):
            best, at = 0.0, -1
            for i in range(len(bands) - 1, max(-1, len(bands) - 1 - look_back), -1):
                shared = max(0.0, min(top + height, bands[i][1]) - max(top, bands[i][0]))
                if shared > best and shared / max(1e-9, min(height, bands[i][1] - bands[i][0])) >= overlap:
                    best, at = shared, i
            if at < 0:
                bands.append([top, top + height])
                at = len(bands) - 1
            else:
                bands[at] = [min(bands[at][0], top), max(bands[at][1], top + height)]
            of.append(at)
        rank = pd.Series([b[0] for b in bands]).rank(method="first").astype("int64") - 1
        page = page.assign(line_id=[int(rank[i]) for i in of]).sort_values(["line_id", "x", "word_id"], kind="stable")
        return page.assign(nth=page.groupby("line_id").cumcount())

    return words.groupBy(*PAGE).applyInPandas(lay, schema)


def line_bands(lines: DataFrame) -> DataFrame:
    """(doc, page, line_id, top, bottom, text) of each line."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "text"))), lambda s: s["text"]), " ")
    return lines.groupBy(*PAGE, "line_id").agg(F.min("y").alias("top"), F.max(F.col("y") + F.col("height")).alias("bottom"), text.alias("text"))


def line_height(height: Column) -> Column:
    """Median word height, 1 where there is none."""
    return F.coalesce(F.median(height), F.lit(1.0))


def character_width(words: DataFrame) -> DataFrame:
    """(doc, page, char_width): median width of a character, 0 on empty pages."""
    n = F.length(F.trim("text"))
    return words.groupBy(*PAGE).agg(F.coalesce(F.median(F.when(n > 0, F.col("width") / n)), F.lit(0.0)).alias("char_width"))


def fields(lines: DataFrame, gap: float = 0.8) -> DataFrame:
    """Fields of each line: words closer than ``gap`` of a line's height belong together.

    (doc, page, line_id, field, text, x, right, top, bottom, height, confidence, n_words). A lone
    currency sign stays with what follows it.
    """
    order = W.partitionBy(*PAGE, "line_id").orderBy("nth")
    space = F.col("x") - F.lag(F.col("x") + F.col("width")).over(order)
    sign = F.lag("text").over(order).isin("$", "€", "£")
    height = F.median("height").over(W.partitionBy(*PAGE, "line_id"))
    opens = F.coalesce(((space > gap * height) & ~sign).cast("int"), F.lit(1))
    split = lines.withColumn("_o", opens).withColumn("field", F.sum("_o").over(order.rowsBetween(W.unboundedPreceding, 0)) - 1)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "text"))), lambda s: s["text"]), " ")
    return split.groupBy(*PAGE, "line_id", "field").agg(
        text.alias("text"), F.min("x").alias("x"), F.max(F.col("x") + F.col("width")).alias("right"), F.min("y").alias("top"),
        F.max(F.col("y") + F.col("height")).alias("bottom"), F.max("height").alias("height"), F.avg("confidence").alias("confidence"), F.count("*").alias("n_words"),
    )


def line_fields(lines: DataFrame, gap: float = 0.8) -> DataFrame:
    """One row a line with what ``fields`` finds in it: (doc, page, line_id, fs array<struct<x, right, text>>, confidence, x, y, bottom, height).

    A line's words are gathered once and parted where they lie, without a row a field in between.
    """
    word = F.struct("x", "word_id", (F.col("x") + F.col("width")).alias("right"), "text", "height")
    grouped = lines.groupBy(*PAGE, "line_id").agg(
        F.sort_array(F.collect_list(word)).alias("ws"), F.avg("confidence").alias("confidence"), F.min("x").alias("x"), F.min("y").alias("y"),
        F.max(F.col("y") + F.col("height")).alias("bottom"), F.min("height").alias("_low"), F.max("height").alias("height"),
    )
    tall = F.when((F.col("_low") == F.col("height")) | F.col("height").isNull(), F.col("height")).otherwise(median(F.transform("ws", lambda w: w["height"])))

    def opens(w: Column, i: Column, before: Column, space: Column) -> Column:
        return F.when((i == 0) | F.coalesce((w["x"] - before["right"] > space) & ~before["text"].isin("$", "€", "£"), F.lit(True)), i)

    def field(ws: Column) -> Column:
        of = lambda c: F.transform(ws, lambda w: w[c])
        return F.struct(F.array_min(of("x")).alias("x"), F.array_max(of("right")).alias("right"), F.array_join(of("text"), " ").alias("text"))

    def cut(ws: Column, start: Column, until: Column) -> Column:
        alone = let(F.get(ws, start), lambda w: F.struct(w["x"].alias("x"), w["right"].alias("right"), w["text"].alias("text")))
        return F.when(until == start + 1, alone).otherwise(let(F.slice(ws, start + 1, until - start), field))

    def parted(k: Column) -> Column:
        starts = F.filter(F.transform(k["ws"], lambda w, i: opens(w, i, F.get(k["ws"], i - 1), k["space"])), lambda i: i.isNotNull())
        return let(starts, lambda at_: F.transform(at_, lambda s, i: cut(k["ws"], s, F.coalesce(F.get(at_, i + 1), F.size(k["ws"])))))

    fs = F.sort_array(let(F.struct("ws", (tall * gap).alias("space")), parted))
    return grouped.select(*PAGE, "line_id", fs.alias("fs"), "confidence", "x", "y", "bottom", "height")


def merge_glyphs(lines: DataFrame, gap: float = 0.35, baseline: float = 0.35) -> DataFrame:
    """Boxes of single characters joined into words, as a fold along each line.

    A box joins its neighbour when the space is at most ``gap`` of a character and the
    centres differ by at most ``baseline`` of the height; confidence is the least.
    """
    n = F.length("text")
    width = F.when(F.count("*").over(W.partitionBy(*PAGE, "line_id")) >= 4, F.median(F.col("width") / n).over(W.partitionBy(*PAGE, "line_id"))).otherwise(F.median(F.col("width") / n).over(W.partitionBy(*PAGE)))
    order = W.partitionBy(*PAGE, "line_id").orderBy("nth")
    space = F.col("x") - F.lag(F.col("x") + F.col("width")).over(order)
    shift = F.abs((F.col("y") + F.col("height") / 2) - F.lag(F.col("y") + F.col("height") / 2).over(order))
    opens = F.coalesce(((space > gap * width) | (shift > baseline * F.col("height"))).cast("int"), F.lit(1))
    runs = lines.withColumn("_o", opens).withColumn("word", F.sum("_o").over(order.rowsBetween(W.unboundedPreceding, 0)) - 1)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "text"))), lambda s: s["text"]), "")
    right, bottom = F.max(F.col("x") + F.col("width")), F.max(F.col("y") + F.col("height"))
    return runs.groupBy(*PAGE, "line_id", "word").agg(
        text.alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("width"), (bottom - F.min("y")).alias("height"), F.min("confidence").alias("confidence")
    )


def without_overprints(lines: DataFrame, near: float = 0.35) -> DataFrame:
    """Words without those drawn again on top of the last kept word of their line (same text,
    starts within ``near`` of the narrower, tops within ``near`` of the taller)."""
    word = "struct<nth:bigint,word_id:bigint,text:string,x:double,y:double,width:double,height:double,confidence:double>"
    rows = lines.groupBy(*PAGE, "line_id").agg(F.sort_array(F.collect_list(F.struct(*(F.col(c).cast(t).alias(c) for c, t in (x.split(":") for x in word[7:-1].split(",")))))).alias("ws"))

    def step(acc: Column, w: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        same = (last["text"] == w["text"]) & (F.abs(last["x"] - w["x"]) <= near * F.least(last["width"], w["width"])) & (F.abs(last["y"] - w["y"]) <= near * F.greatest(last["height"], w["height"]))
        return F.when(F.coalesce(same, F.lit(False)), acc).otherwise(F.concat(acc, F.array(w)))

    kept = rows.select(*PAGE, "line_id", F.explode(F.aggregate("ws", F.array().cast(f"array<{word}>"), step)).alias("w"))
    return kept.select(*PAGE, "line_id", "w.*")


def union_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, hi): touching intervals merged."""
    order = W.partitionBy(*keys).orderBy("lo", "hi")
    opens = F.coalesce((F.col("lo") > F.max("hi").over(order.rowsBetween(*BEFORE))).cast("int"), F.lit(1))
    marked = spans.withColumn("_o", opens).withColumn("_g", F.sum("_o").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_g")


def coverage(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, hi, depth): how many intervals lie over each stretch between neighbouring ends."""
    ends = spans.select(*keys, F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("step")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("step")))).alias("e")).select(*keys, "e.*")
    steps = ends.groupBy(*keys, "at").agg(F.sum("step").alias("step"))
    order = W.partitionBy(*keys).orderBy("at")
    swept = steps.select(*keys, F.col("at").alias("lo"), F.lead("at").over(order).alias("hi"), F.sum("step").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("long").alias("depth"))
    return swept.where("hi IS NOT NULL")


def gutters(covered: DataFrame, keys: list[str], allowed: int = 0) -> DataFrame:
    """(keys, lo, hi): the stretches that at most ``allowed`` intervals cover, joined, widest first by ``rank``."""
    free = union_spans(covered.where(F.col("depth") <= allowed).select(*keys, "lo", "hi"), keys)
    widest = W.partitionBy(*keys).orderBy(F.desc(F.col("hi") - F.col("lo")), F.desc("lo"))
    return free.withColumn("rank", F.row_number().over(widest))


def assign_to_anchors(items: DataFrame, anchors: DataFrame, keys: list[str], above: float, below: float) -> DataFrame:
    """Items (keys, item, at) with the nearest anchor (keys, anchor, at) from ``above`` before to ``below`` after it.

    Places are cut into cells as wide as the reach, so the range join is an equality join
    on (keys, cell) with three cells an anchor; the earlier anchor wins ties.
    """
    reach = float(max(above, below)) or 1.0
    cell = F.floor(F.col("at") / reach)
    spots = anchors.select(*keys, "anchor", F.col("at").alias("anchor_at"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    near = items.withColumn("cell", cell).join(spots, [*keys, "cell"]).where((F.col("at") - F.col("anchor_at") >= -above) & (F.col("at") - F.col("anchor_at") <= below))
    nearest = F.min_by(F.struct("anchor", "anchor_at"), F.struct(F.abs(F.col("at") - F.col("anchor_at")), F.col("anchor_at"), F.col("anchor")))
    return near.groupBy(*keys, "item", "at").agg(nearest.alias("n")).select(*keys, "item", "at", "n.anchor", "n.anchor_at")


def row_pitch(anchors: DataFrame, keys: list[str], default: float | Column) -> DataFrame:
    """(keys, pitch): median of the gaps over 4 between neighbouring anchors; ``default``, a number or an aggregate, without such."""
    gap = F.col("at") - F.lag("at").over(W.partitionBy(*keys).orderBy("at"))
    return anchors.withColumn("gap", gap).groupBy(*keys).agg(F.coalesce(F.median(F.when(F.col("gap") > 4, F.col("gap"))), F.lit(default)).alias("pitch"))


def repeated_edges(words: DataFrame, keys: list[str], lines: int = 8) -> DataFrame:
    """(keys, edge, n): left edges on at least half of the first ``lines`` lines, two at least.

    words: (keys, line_id, x, height). An edge joins the edges before it while it lies
    within a tolerance (10, or 0.8 of the mean height) of their mean so far, which no
    window frame holds: a fold over the at most ``lines`` lines' sorted edges.
    """
    nth = F.dense_rank().over(W.partitionBy(*keys).orderBy("line_id"))
    used = words.withColumn("_n", nth).where(F.col("_n") <= lines).groupBy(*keys).agg(F.sort_array(F.collect_list("x")).alias("xs"), F.avg("height").alias("height"), F.max("_n").alias("lines"))
    cluster = "array<struct<sum: double, n: bigint>>"
    tolerance = F.greatest(F.lit(10.0), F.col("height") * 0.8)

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = F.coalesce(x - last["sum"] / last["n"] <= tolerance, F.lit(False))
        grown = F.struct((last["sum"] + x).alias("sum"), (last["n"] + 1).alias("n"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(F.struct(x.cast("double").alias("sum"), F.lit(1).cast("long").alias("n"))))).cast(cluster)

    folded = used.where("lines >= 2").select(*keys, F.greatest(F.lit(2), F.ceil(F.col("lines") * 0.5)).alias("least"), F.explode(F.aggregate("xs", F.array().cast(cluster), add)).alias("c"))
    return folded.where("c.n >= least").select(*keys, (F.col("c.sum") / F.col("c.n")).alias("edge"), F.col("c.n").alias("n"))


def column_index(centre: Column, bounds: Column) -> Column:
    """The last bound at or before the centre, the first column if none is."""
    return F.greatest(F.size(F.filter(bounds, lambda b: b <= centre)) - 1, F.lit(0))



def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Pairs of intervals (lo, hi) of one key that share more than an end: all columns of both sides, ``right``'s lo and hi as other_lo, other_hi.

    Both sides go to every cell of width ``cell`` that they touch, so the range join is an
    equality join on (keys, cell), which a hot key does not skew beyond its cells; a pair
    counts in the cell of its later start alone, so none comes twice. Take ``cell`` near
    the usual length: an interval has one row a cell. Intervals without extent or with nulls meet none.
    Other columns must differ in name.
    """
    cells = F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell)))
    a = left.where("lo < hi").withColumn("_cell", cells)
    b = right.where("lo < hi").withColumn("_cell", cells).withColumnsRenamed({"lo": "other_lo", "hi": "other_hi"})
    met = a.join(b, [*keys, "_cell"]).where((F.col("lo") < F.col("other_hi")) & (F.col("other_lo") < F.col("hi")))
    return met.where(F.col("_cell") == F.floor(F.greatest("lo", "other_lo") / cell)).drop("_cell")


def assign_rows(items: DataFrame, anchors: DataFrame, keys: list[str], default_pitch: float | Column, overlap: float = 0.5, below: float = 0.6) -> DataFrame:
    """Items (keys, item, at) with the row they belong to, of anchors (keys, anchor, at, nth).

    Reach follows from the pitch of the key's own rows: ``below`` of it downwards, 0.1 + 0.4 x ``overlap``
    of it (0.35 at most) upwards. In the upper half of that upward reach a row costs 0.75 of a pitch more, so a word between two
    rows stays with the row above; of equals the first by ``nth``. Places are cut into cells as wide as the key's
    reach, so the join is on (keys, cell). Items without a row in reach are left out.
    """
    pitch = row_pitch(anchors, keys, default_pitch)
    up = min(0.35, 0.1 + overlap * 0.4)
    reach = F.col("pitch") * max(up, below)
    cell = F.floor(F.col("at") / reach)
    spots = anchors.join(pitch, keys).select(*keys, "anchor", "nth", "pitch", F.col("at").alias("anchor_at"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    near = items.join(pitch, keys).withColumn("cell", cell).drop("pitch").join(spots, [*keys, "cell"]).withColumn("delta", F.col("at") - F.col("anchor_at"))
    near = near.where((F.col("delta") >= -F.col("pitch") * up) & (F.col("delta") <= F.col("pitch") * below))
    distance = F.abs("delta") + F.when(F.col("delta") >= -F.col("pitch") * up * 0.5, 0.0).otherwise(F.col("pitch") * 0.75)
    return near.groupBy(*keys, "item", "at").agg(F.min_by("anchor", F.struct(distance, F.col("nth"))).alias("anchor"))
