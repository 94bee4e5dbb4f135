"""Repairs of recognised text that look at a whole page, and the pixel steps before recognition."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from tablewright.functions.arrays import at, let


def name_columns(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, left, right, top): where an inventory prints its names, from its lines (keys, line_id, text, x, y, width, height).

    Name begins a little before the middle of ``Game Name``, the counts' titles end it, and it
    lies below both. Of several such lines the last counts; pages without one of the two give nothing.
    """
    key = F.lower(F.regexp_replace("text", r"(?U)\s+", ""))
    titled = lines.withColumn("_title", F.when(key.startswith("gamename"), "game").when(key.startswith("intrec"), "counts")).where("_title IS NOT NULL")
    last = lambda t: F.max_by(F.struct("x", "y", "width", "height"), F.when(F.col("_title") == t, F.col("line_id"))).alias(t)
    both = titled.groupBy(*keys).agg(last("game"), last("counts")).where("game IS NOT NULL AND counts IS NOT NULL")
    top = F.greatest(F.col("game.y") + F.col("game.height"), F.col("counts.y") + F.col("counts.height"))
    return both.select(*keys, (F.col("game.x") + F.col("game.width") * 0.45).alias("left"), F.col("counts.x").alias("right"), top.alias("top"))


def modal_pack_digits(tokens: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """(keys, digits): the most frequent suffix length of clean pack codes, from ``least`` sightings;
    the length seen first wins ties. tokens: (keys, seq, text)."""
    clean = tokens.where(F.col("text").rlike("^[0-9]{3}-[0-9]{5,8}$")).withColumn("digits", F.length("text") - 4)
    counted = clean.groupBy(*keys, "digits").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return counted.groupBy(*keys).agg(F.max_by(F.struct("digits", "n"), F.struct("n", (-F.col("first")).alias("f"))).alias("m")).where(F.col("m.n") >= least).select(*keys, "m.digits")


def structural_cuts(token: Column, digits: Column) -> Column:
    """A token cut behind a leading pack code (of ``digits`` digits where a page's length is known and shorter) and around dates.

    A code takes five to eight digits; where what follows starts with digits it would take
    too many of them.
    """
    code = F.length(F.regexp_extract(token, "^[0-9]{3}-[0-9]{5,8}", 0))
    end = F.when(code > 0, F.least(code, F.coalesce(digits + 4, code)))
    parts = F.filter(F.split(F.regexp_replace(token, "([0-9]{2}/[0-9]{2}/[0-9]{2,4})", "\x00$1\x00"), "\x00"), lambda p: p != "")

    def add(acc: Column, p: Column) -> Column:
        inside = end - acc["at"]
        halves = F.array(F.substring(p, F.lit(1), inside.cast("int")), F.substring(p, (inside + 1).cast("int"), F.length(p)))
        cut = F.when((inside > 0) & (inside < F.length(p)), halves).otherwise(F.array(p))
        return F.struct((acc["at"] + F.length(p)).alias("at"), F.concat(acc["out"], cut).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), add, lambda acc: acc["out"])


@F.pandas_udf(types.ArrayType(types.StringType()))
def compatible(readings: pd.Series) -> pd.Series:
    """Readings with look-alike characters (wide letters, ligatures) in their plain form."""
    return readings.map(lambda rs: None if rs is None else [unicodedata.normalize("NFKC", r) for r in rs])


def vote_characters(original: Column, readings: Column) -> Column:
    """The original with each character replaced on which all rereadings agree, case aside.

    ``readings`` are in compatible form (see above, as a column of its own). Blanks are not voted on. A rereading of another number of characters cannot be lined
    up: then, and without rereadings, the original stays as it is.
    """
    solid = lambda t: F.filter(F.split(t, ""), lambda c: (c != "") & ~c.rlike(r"(?U)^\s$"))
    read = F.transform(readings, solid)
    usable = (F.size(read) > 0) & F.forall(read, lambda r: F.size(r) == F.size(solid(original)))
    chars = F.filter(F.split(original, ""), lambda c: c != "")

    def add(acc: Column, c: Column) -> Column:
        votes = F.array_distinct(F.transform(read, lambda r: F.get(r, acc["at"])))
        blank = c.rlike(r"(?U)^\s$")
        won = F.when(~blank & (F.size(votes) == 1) & (F.lower(votes[0]) != F.lower(c)), votes[0]).otherwise(c)
        return F.struct((acc["at"] + F.when(blank, 0).otherwise(1)).alias("at"), F.concat(acc["out"], won).alias("out"))

    voted = F.aggregate(chars, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda acc: acc["out"])
    return F.when(usable, voted).otherwise(original)


def ink_level(grey: np.ndarray) -> np.ndarray:
    """Dark pixels as they are, lighter ones lifted towards white by the square of their distance."""
    t = np.clip((grey.astype(np.float64) - 48) / 80, 0, 1)
    return np.where(grey <= 48, grey, np.rint(48 + t * t * 207)).astype(np.uint8)


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def ink_gaps(page: np.ndarray, dark: int = 128, share: float = 0.32) -> list[tuple[int, int]]:
    """Blank column runs at least ``share`` of the cap height wide, between the first and the last ink."""
    ink = page < dark
    if not ink.any():
        return []
    heights = ink.sum(0)
    cap = np.quantile(heights[heights > 0], 0.9)
    cols = np.flatnonzero(heights)
    return [(a + cols[0], b + cols[0]) for a, b in runs(heights[cols[0] : cols[-1] + 1] == 0) if b - a >= share * cap]


def suppress_colour(rgb: np.ndarray, chroma: int = 45) -> tuple[np.ndarray, float]:
    """Grey page without reddish stamp strokes, and the share of pixels that were whitened."""
    r, g, b = (rgb[..., i].astype(np.int16) for i in range(3))
    red = (r > g) & (r > b) & (np.maximum(np.maximum(r, g), b) - np.minimum(np.minimum(r, g), b) >= chroma)
    grey = np.rint(0.299 * r + 0.587 * g + 0.114 * b).astype(np.uint8)
    faint = red & (grey >= 128)
    tall = max(36, round(0.03 * rgb.shape[0]))
    for x in range(rgb.shape[1]):
        for a, z in runs(red[:, x]):
            if z - a >= tall:
                faint[a:z, x] = True
    return np.where(faint, 255, grey).astype(np.uint8), float(faint.mean())


def ink_gaps_of(pixels: Column, width: Column, height: Column) -> Column:
    """Gaps of grey pages given as bytes, row by row, as array<struct<start, end>>."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def find(p: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([[{"start": int(a), "end": int(b)} for a, b in ink_gaps(np.frombuffer(x, np.uint8).reshape(n, m))] for x, m, n in zip(p, w, h, strict=True)])

    return find(pixels, width, height)


SPACED = "struct<text: string, spans: array<struct<lo: double, hi: double>>>"


def restore_spaces(text: Column, spans: Column, gaps: Column, glyphs: Column) -> Column:
    """struct<text, spans>: a blank back at each white run that the print shows.

    ``spans`` are struct<lo, hi> of each character, ``gaps`` the middles of white runs, ``glyphs`` the counts of
    glyphs between them. Where the counts are whole and add up to the characters read, words are cut by their
    lengths; else each run goes between the two neighbours whose middles enclose it, the
    nearest of several. Text stays as it is if spans and characters differ in number or nothing fits.
    """
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    each = F.transform(F.arrays_zip(chars.alias("c"), spans.alias("s")), lambda e: F.struct(e["c"].alias("c"), e["s"]["lo"].alias("lo"), e["s"]["hi"].alias("hi")))
    piece = "array<struct<c: string, lo: double, hi: double>>"
    blank = lambda a, b: F.struct(F.lit(" ").alias("c"), F.least(a["hi"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["lo"]).alias("hi"))

    def spread(each: Column, breaks: Column) -> Column:
        """Characters with a blank after those whose index is in ``breaks``."""
        return F.flatten(F.transform(each, lambda e, i: F.when(F.array_contains(breaks, i), F.array(e, blank(e, at(each, i + 1)))).otherwise(F.array(e)).cast(piece)))

    def by_counts(each: Column) -> Column:
        kept = F.filter(each, lambda e: ~e["c"].rlike(r"^\s$"))
        ends = F.transform(F.slice(glyphs, 1, F.greatest(F.size(glyphs) - 1, F.lit(0))), lambda _, i: F.aggregate(F.slice(glyphs, 1, i + 1), F.lit(0), lambda a, n: a + n) - 1)
        return let(kept, lambda k: F.when((F.size(glyphs) == F.size(gaps) + 1) & F.forall(glyphs, lambda n: n > 0) & (F.aggregate(glyphs, F.lit(0), lambda a, n: a + n) == F.size(k)), spread(k, ends)))

    def by_spans(each: Column) -> Column:
        middles = F.transform(each, lambda e: (e["lo"] + e["hi"]) / 2)
        inked = lambda i: ~at(each, i)["c"].rlike(r"^\s$")

        def place(gap: Column, m: Column) -> Column:
            fit = F.transform(F.sequence(F.lit(0), F.size(each) - 2), lambda i: F.when(inked(i) & inked(i + 1) & gap.between(at(m, i), at(m, i + 1)), F.struct(F.abs(gap - (at(m, i) + at(m, i + 1)) / 2).alias("far"), i.alias("i"))))
            return F.array_min(fit)["i"]

        breaks = let(middles, lambda m: F.filter(F.transform(gaps, lambda g: place(g, m)), lambda i: i.isNotNull()))
        return let(breaks, lambda b: spread(each, b))

    usable = (F.size(spans) == F.length(text)) & (F.length(text) >= 2) & (F.size(gaps) > 0)
    parted = let(each, lambda e: F.coalesce(by_counts(e), by_spans(e)))
    made = let(parted, lambda p: F.struct(F.array_join(F.transform(p, lambda e: e["c"]), "").alias("text"), F.transform(p, lambda e: F.struct(e["lo"].alias("lo"), e["hi"].alias("hi"))).alias("spans")))
    return F.when(usable, made).otherwise(F.struct(text.alias("text"), spans.alias("spans"))).cast(SPACED)


def line_words(text: Column, x: Column, y: Column, width: Column, height: Column, digits: Column, spans: Column | None = None) -> Column:
    """A recognised line as words: array of struct<text, x, y, width, height>, cut at blanks, behind pack codes and around dates.

    A piece gets the share of the line's box that its characters have, blanks counted; with
    ``spans`` (struct<lo, hi> of each character of ``text``, as many of them) it lies where
    they were read. Null and blank texts and boxes without extent give no word.
    """
    word = "array<struct<text: string, x: double, y: double, width: double, height: double>>"
    said = F.regexp_replace(text, r"^\s+|\s+$", "")
    lead = F.length(text) - F.length(F.regexp_replace(text, r"^\s+", ""))
    before = lambda parts, i, blanks: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, p: a + F.length(p) + blanks)

    def cut(parts: Column) -> Column:
        pieces = F.transform(parts, lambda t, i: let(structural_cuts(t, digits), lambda ps: F.transform(ps, lambda p, j: F.struct(p.alias("p"), (before(parts, i, 1) + before(ps, j, 0)).alias("at")))))
        return F.filter(F.flatten(pieces), lambda e: e["p"] != "")

    def place(k: Column) -> Column:
        n = F.length(k["said"])

        def of(e: Column) -> Column:
            left, wide = x + width * e["at"] / n, width * F.length(e["p"]) / n
            if spans is not None:
                whole, first = F.size(spans) == F.length(text), k["lead"] + e["at"]
                low, high = at(spans, first)["lo"], at(spans, first + F.length(e["p"]) - 1)["hi"]
                left, wide = F.when(whole, low).otherwise(left), F.when(whole, F.greatest(high - low, F.lit(1e-3))).otherwise(wide)
            return F.struct(e["p"].alias("text"), left.alias("x"), y.alias("y"), wide.alias("width"), height.alias("height"))

        return F.transform(cut(F.split(k["said"], r"\s")), of)

    some = (said != "") & (width > 0) & (height > 0)
    return F.when(some, let(F.struct(said.alias("said"), lead.alias("lead")), place).cast(word)).otherwise(F.array().cast(word))


def page_words(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Recognised lines (keys, line, text, x, y, width, height, confidence, and spans or none) as words with word_id, in two passes.

    The first finds each page's usual length of pack codes from its whole tokens; the
    second cuts every line by it, as glued lines cannot tell it themselves. One exchange by page for the
    counts, which are small; lines meet them by page.
    """
    tokens = lines.select(*keys, "line", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("i", "text")).withColumn("seq", F.col("line").cast("long") * 100_000 + F.col("i"))
    usual = modal_pack_digits(tokens, keys)
    spans = F.col("spans") if "spans" in lines.columns else None
    cut = line_words(F.col("text"), F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.col("digits"), spans)
    words = lines.join(usual, keys, "left").select(*keys, "line", "confidence", F.posexplode(cut).alias("nth", "w"))
    return words.select(*keys, (F.col("line").cast("long") * 100_000 + F.col("nth")).alias("word_id"), "w.*", "confidence")
