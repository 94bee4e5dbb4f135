"""Repairs and findings on words that need their neighbours: glued counts, split packs, lone dates, headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.functions.arrays import at, largest, let, once

from .geometry import PAGE, fields, group_lines
from .tables import header_lines

# A pack code, and the widest gap between its halves.
PACK, HALVES_APART = "^[0-9]{3}-[0-9]{5,8}$", 24.0


def count_parts(text: Column) -> Column:
    """The two to four three-digit counts glued in a text, else the text alone."""
    parts = let(T.token_core(text), lambda token: let(F.regexp_replace(token, "[^0-9]", ""), lambda digits: _parts_of(token, digits)))
    return F.coalesce(parts, F.array(text))


def _parts_of(token: Column, digits: Column) -> Column:
    n = F.floor(F.length(digits) / 3).cast("int")
    glued = token.rlike(r"^[0-9]{3}(?:[.\s-]?[0-9]{3})+$") & ~token.rlike(PACK) & n.between(2, 4)
    return F.when(glued, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(digits, i * 3 + 1, F.lit(3))))


def split_counts(words: DataFrame) -> DataFrame:
    """``words`` with a run of two to four glued three-digit counts as words of equal width."""
    cut = once(words, _parts=count_parts(F.col("text"))).select("*", F.posexplode("_parts").alias("_i", "_part"))
    share = F.col("width") / F.size("_parts")
    made = {"word_id": F.when(F.size("_parts") > 1, F.xxhash64("word_id", "_i")).otherwise(F.col("word_id")), "text": F.col("_part"), "x": F.col("x") + share * F.col("_i"), "width": share}
    return cut.select(*(made[c].alias(c) if c in made else F.col(c) for c in words.columns))


def tight_counts(lines: DataFrame, n: int = 4) -> DataFrame:
    """(doc, page, line_id, counts): the ``n`` neighbouring counts of a line that lie closest; the first such run."""
    counts = once(split_counts(lines), _n=T.count_value(F.col("text"))).where(F.coalesce("_n", F.lit("")) != "")
    order = W.partitionBy(*PAGE, "line_id").orderBy("x", "word_id")
    run = F.collect_list("text").over(order.rowsBetween(0, n - 1))
    spans = counts.select(*PAGE, "line_id", "x", run.alias("run"), (F.lead("x", n - 1).over(order) - F.col("x")).alias("span")).where("span IS NOT NULL")
    return spans.groupBy(*PAGE, "line_id").agg(F.min_by("run", F.struct("span", "x")).alias("counts"))


def line_packs(lines: DataFrame) -> DataFrame:
    """(doc, page, line_id, pack, halves): a line's first pack code: hyphened, bare, or in two words side by side."""
    order = W.partitionBy(*PAGE, "line_id").orderBy("x", "y", "word_id")
    token, after = T.pack_token(F.col("text")), F.lead("text").over(order)
    hyphened = lambda c: F.regexp_replace(c, "^([0-9]{3})([0-9]{5,8})$", "$1-$2")
    near = F.lead("x").over(order) - (F.col("x") + F.col("width")) <= HALVES_APART
    both = hyphened(F.concat(token, T.token_core(after)))
    found = lines.withColumns({"_one": F.when(hyphened(token).rlike(PACK), hyphened(token)), "_two": F.when(near & both.rlike(PACK), both)})
    pack = F.struct(F.coalesce("_one", "_two").alias("pack"), F.when(F.col("_one").isNull(), 2).otherwise(1).alias("halves"))
    first = found.where("_one IS NOT NULL OR _two IS NOT NULL").groupBy(*PAGE, "line_id").agg(F.min_by(pack, F.struct("x", "y", "word_id")).alias("p"))
    return first.select(*PAGE, "line_id", "p.pack", "p.halves")


def middle(values: Column) -> Column:
    """Median of an array, null if it is empty."""
    at_half = lambda s, more: F.try_element_at(s, F.floor((F.size(s) + more) / 2).cast("int"))
    return let(F.sort_array(values), lambda s: F.when(F.size(s) > 0, (at_half(s, 1) + at_half(s, 2)) / 2))


def with_lone_dates(words: DataFrame, least: int = 3) -> DataFrame:
    """``words`` (with ``pack`` and ``date``, null where a word is none) with ``lone``.

    A lone date has no pack within half a row, stands within one and a half rows of the
    packs and in the column of the dates that have one, and shares its band with no other
    date. All is gathered over the page's own window, so no join is needed.
    """
    page = W.partitionBy(*PAGE)
    centre, is_date = F.col("y") + F.col("height") / 2, F.col("date").isNotNull()
    packs = F.sort_array(F.collect_list(F.when(F.col("pack").isNotNull(), centre)).over(page))
    dates = F.collect_list(F.when(is_date, F.struct("word_id", "y", (F.col("y") + F.col("height")).alias("bottom")))).over(page)
    w = words.withColumns({"_packs": packs, "_dates": dates})
    gaps = F.filter(F.zip_with(F.slice("_packs", 2, F.greatest(F.size("_packs") - 1, F.lit(0))), F.slice("_packs", 1, F.greatest(F.size("_packs") - 1, F.lit(0))), lambda b, a: b - a), lambda g: g > 4)
    level = F.array_contains("_packs", centre) & (F.abs(centre) < float("inf"))  # beside a pack, whatever the pitch
    w = once(w, _pitch=F.when(is_date & ~level, F.coalesce(middle(gaps), F.greatest(F.lit(24.0), 1.6 * F.col("height")))))
    w = once(w, _paired=is_date & (level | F.exists("_packs", lambda p: F.abs(p - centre) < F.col("_pitch") * 0.5)))
    mid = F.col("x") + F.col("width") / 2
    w = w.withColumns({"_column": F.median(F.when(F.col("_paired"), mid)).over(page), "_width": F.median(F.when(F.col("_paired"), F.col("width"))).over(page)})
    alone = ~F.exists("_dates", lambda d: (d["word_id"] != F.col("word_id")) & (F.least(d["bottom"], F.col("y") + F.col("height")) > F.greatest(d["y"], F.col("y"))))
    inside = (centre > F.array_min("_packs") - 1.5 * F.col("_pitch")) & (centre < F.array_max("_packs") + 1.5 * F.col("_pitch"))
    lone = is_date & (F.size("_packs") >= least) & ~F.col("_paired") & inside & (F.abs(mid - F.col("_column")) < F.col("_width")) & alone
    return once(w, lone=F.coalesce(lone, F.lit(False))).select(*words.columns, "lone")


def table_headings(words: DataFrame, reach: float = 3.0, most: int = 5) -> DataFrame:
    """(doc, page, heading): the last short line without a price within ``reach`` line heights above the titles."""
    lines = group_lines(words.where(F.trim("text") != ""))
    titles = header_lines(fields(lines)).select(*PAGE, F.col("line_id").alias("titles"))
    bands = lines.groupBy(*PAGE, "line_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "text"))), lambda s: F.trim(s["text"])), " ").alias("text"),
        F.min("y").alias("top"), F.max(F.col("y") + F.col("height")).alias("bottom"), F.median("height").alias("h"), F.count("*").alias("n"),
    )
    page = W.partitionBy(*PAGE)
    placed = bands.join(titles, PAGE).withColumns({"at": F.max(F.when(F.col("line_id") == F.col("titles"), F.col("top"))).over(page), "line": F.max(F.when(F.col("line_id") == F.col("titles"), F.col("h"))).over(page)})
    near = (F.col("bottom") <= F.col("at") - 1) & (F.col("bottom") >= F.col("at") - reach * F.col("line"))
    short = F.col("text").rlike("[A-Za-z]") & (F.col("n") <= most) & ~F.col("text").rlike(r"[0-9][.,][0-9]{2}|[$€£]")
    return placed.where(near & short).groupBy(*PAGE).agg(F.max_by("text", "line_id").alias("heading"))


def label_words(words: Column) -> Column:
    """A row's label of the words between its number and its counts, without stray fragments at either end.

    Short words (3 characters) far from the rest go: at the left, beyond 1.5 heights and three times the usual gap;
    at the right, beyond 1.5 heights of its neighbour. Then lone letters go unless set at
    word spacing (1.2 heights), marks at the ends of words, and what lies left of 0.45 of the middle start.
    """
    return let(F.sort_array(F.filter(words, lambda w: w["text"].rlike("[A-Za-z0-9&$]"))), _label)


def _label(inked: Column) -> Column:
    right = lambda w: w["x"] + w["width"]
    short = lambda w: F.length(F.trim(w["text"])) <= 3
    gap = lambda ws, i: at(ws, i)["x"] - right(at(ws, i - 1))

    def from_left(ws: Column, _: Column) -> Column:
        rest = F.array_sort(F.transform(F.sequence(F.lit(2), F.size(ws) - 1), lambda i: gap(ws, i)))
        usual = F.when(F.size(ws) >= 4, let(rest, lambda r: at(r, F.floor(F.size(r) / 2)))).otherwise(0.0)
        far = gap(ws, F.lit(1)) > F.greatest(largest(ws, lambda w: w["height"]) * 1.5, usual * 3)
        return F.when((F.size(ws) >= 2) & short(at(ws, 0)) & far, F.slice(ws, 2, F.size(ws))).otherwise(ws)

    def from_right(ws: Column, _: Column) -> Column:
        n = F.size(ws)
        far = gap(ws, n - 1) > F.greatest(at(ws, n - 1)["height"], at(ws, n - 2)["height"]) * 1.5
        return F.when((n >= 2) & short(at(ws, n - 1)) & far, F.slice(ws, 1, n - 1)).otherwise(ws)

    def said(ws: Column) -> Column:
        starts = F.array_sort(F.transform(ws, lambda w: w["x"]))
        margin = F.coalesce(at(starts, F.floor(F.size(ws) / 2)), F.lit(0.0)) * 0.45
        near = lambda w, i: F.coalesce(gap(ws, i).between(0.0, w["height"] * 1.2), F.lit(False))

        def token(w: Column, i: Column) -> Column:
            bare = F.regexp_replace(F.trim(w["text"]), "^[^A-Za-z0-9&$/]+|[^A-Za-z0-9&$/!?]+$", "")
            spaced = F.trim(w["text"]).rlike("^[A-Za-z]$") & (near(w, i) | F.coalesce(gap(ws, i + 1).between(0.0, w["height"] * 1.2), F.lit(False)))
            lone = (F.length(bare) == 1) & ~bare.rlike("[0-9&]") & ~spaced
            return F.when(~((F.size(ws) >= 3) & (right(w) < margin)) & ~lone & bare.rlike("[A-Za-z0-9&$]"), bare)

        return F.array_join(F.filter(F.transform(ws, token), lambda t: t.isNotNull()), " ")

    turns = F.sequence(F.lit(1), F.greatest(F.size(inked), F.lit(1)))  # a turn takes one word away at most
    return let(F.aggregate(turns, F.aggregate(turns, inked, from_left), from_right), said)
