"""Every column table of a page: titles, edges learned from the rows, rows with what continues them, and a reason for every line left out.

words -> lines -> headers -> tables -> edges -> columns' profiles -> rows and log. Words
are shuffled once, by page; a table is then a row with its lines, a line a row
with its fields, and both are grouped within the partition they lie in. Pages without
titles read under the edges learned on the last page of their document that has some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.functions.arrays import at, let, union
from tablewright.sources.rest import at_rest

from . import layout
from .geometry import PAGE, group_lines
from .headers import column_bounds, find_headers, right

KEYS = [*PAGE, "nth"]
#: Where the last table of a page ends.
BELOW = 1e300


def sound() -> Column:
    """Whether a word has text and extent."""
    return (F.trim("text") != "") & (F.col("width") > 0) & (F.col("height") > 0) & (F.abs(F.col("x") + F.col("y") + F.col("width") + F.col("height")) < float("inf"))


def page_lines(words: DataFrame) -> DataFrame:
    """(doc, page, line_height, lines): lines from the top, each struct<top, line_id, bottom, left, confidence, words>.

    Words without text or extent take no part; a page needs four others.
    """
    page = Window.partitionBy(*PAGE)
    usable = group_lines(words.where(sound())).withColumn("line_height", F.median("height").over(page)).withColumn("n", F.count("*").over(page)).where("n >= 4")
    word = F.struct(*(F.col(c).cast("string" if c == "text" else "double").alias(c) for c in ("x", "y", "text", "width", "height")))
    lines = usable.groupBy(*PAGE, "line_id", "line_height").agg(
        F.min("y").alias("top"), F.max(F.col("y") + F.col("height")).alias("bottom"), F.min("x").alias("left"), F.avg("confidence").alias("confidence"), F.sort_array(F.collect_list(word)).alias("words"))
    return at_rest(lines.groupBy(*PAGE, "line_height").agg(F.sort_array(F.collect_list(F.struct("top", "line_id", "bottom", "left", "confidence", "words"))).alias("lines")))


def titled_tables(pages: DataFrame) -> DataFrame:
    """One row a printed header: its columns and edges, the heading over it, and the lines from there to the next header."""
    heads = find_headers(pages.select(*PAGE, "line_height", F.flatten(F.transform("lines", lambda l: l["words"])).alias("words")))
    heads = heads.withColumn("until", F.coalesce(F.lead("top").over(Window.partitionBy(*PAGE).orderBy("nth")), F.lit(BELOW)))
    df = pages.join(heads, PAGE)
    in_title = lambda k, w: F.exists(k["titles"], lambda t: (t["x"] == w["x"]) & (t["y"] == w["y"]) & (t["text"] == w["text"]))
    below = lambda k: F.filter(k["lines"], lambda l: (l["top"] >= k["bottom"] - 2) & (l["top"] < k["until"]) & ~F.exists(l["words"], lambda w: in_title(k, w)))
    body = let(F.struct("lines", "titles", "bottom", "until"), below)
    heading = F.when(F.col("nth") > 0, heading_above(F.col("lines"), F.col("top"), F.col("line_height")))
    return df.select(*KEYS, "line_height", "columns", column_bounds(F.col("columns")).alias("printed"), F.lit(True).alias("titled"), "top", heading.alias("title"), body.alias("lines"))


def heading_above(lines: Column, top: Column, line_height: Column) -> Column:
    """The heading a table is printed under: the last line within three heights above with letters, five words at most and no money."""
    def said(k: Column) -> Column:
        texts = F.transform(F.filter(k["lines"], lambda l: (l["bottom"] <= k["top"] - 1) & (l["bottom"] >= k["top"] - k["h"] * 3)), lambda l: F.array_join(F.transform(l["words"], lambda w: F.trim(w["text"])), " "))
        return F.try_element_at(F.filter(texts, lambda t: t.rlike("[A-Za-z]") & (F.size(F.split(t, r"\s+")) <= 5) & ~t.rlike(r"[0-9][.,][0-9]{2}|[$€£]")), F.lit(-1))

    return let(F.struct(lines.alias("lines"), top.alias("top"), line_height.alias("h")), said)


def _as_lines(tables: DataFrame, *carried: str) -> DataFrame:
    """One row a line of each table."""
    return tables.select(*KEYS, "line_height", "columns", "titled", *carried, F.explode("lines").alias("l")).select(*KEYS, "line_height", "columns", "titled", *carried, "l.*")


def _as_tables(lines: DataFrame, fields: list[str], *carried: str) -> DataFrame:
    """Lines of one table in one row again, from the top; ``fields`` of them are kept."""
    kept = F.struct("top", "line_id", *[f for f in fields if f not in ("top", "line_id")])
    return lines.groupBy(*KEYS).agg(*(F.first(c).alias(c) for c in ("line_height", "columns", "titled", *carried)), F.sort_array(F.collect_list(kept)).alias("lines"))


LINE = ["top", "line_id", "bottom", "left", "confidence", "fields"]


def _cells(bounds: str, profiles: str | None = None) -> Column:
    return layout.buckets(F.col("fields"), F.col("columns"), F.col(bounds), F.col("line_height"), F.col("titled"), None if profiles is None else F.col(profiles))


def _is_item(buckets: Column) -> Column:
    return let(F.transform(buckets, layout.join_words), lambda c: T.is_line_item(c) & ~T.is_summary(c, F.lit(True)))


def with_items(tables: DataFrame, bounds: str) -> DataFrame:
    """Tables whose lines have ``item``, as they read under ``bounds``, and the items' number."""
    lines = _as_lines(tables.withColumn("edges", F.col(bounds)), "printed", "edges")
    if "fields" not in lines.columns:
        lines = lines.withColumn("fields", layout.fields_on_line(F.col("words"), F.col("line_height"))).drop("words")
    made = _as_tables(lines.withColumn("item", _is_item(_cells("edges"))), [*LINE, "item"], "printed", "edges")
    return made.withColumn("n_items", F.size(F.filter("lines", lambda l: l["item"])))


def _spans(fields: Column) -> Column:
    return union(F.transform(F.flatten(fields), lambda w: F.struct(w["x"].alias("lo"), right(w).alias("hi"))))


def settled(tables: DataFrame) -> DataFrame:
    """Tables (with_items) with ``edges`` moved out of ink, ``char_width`` and their lines' items."""
    width = layout.character_width(F.flatten(F.flatten(F.transform(F.filter("lines", lambda l: l["item"]), lambda l: l["fields"]))))
    tables = tables.withColumn("char_width", F.coalesce(F.nullif(width, F.lit(0.0)), F.col("line_height") * 0.5))
    lines = _as_lines(tables, "printed", "edges", "char_width", "n_items")
    told = F.transform("fields", lambda ws: F.struct(layout.owned_field(ws).alias("own"), F.transform(layout.parts_across_titles(ws, F.col("columns")), lambda p: F.struct(p["col"].alias("col"), layout.owned_field(p["words"]).alias("field"))).alias("parts")))
    lines = lines.withColumn("told", F.when(F.col("item") & F.col("titled"), told)).withColumn("spans", F.when(F.col("item"), _spans(F.col("fields"))))
    tables = at_rest(_as_tables(lines, [*LINE, "item", "told", "spans"], "printed", "edges", "char_width", "n_items"))
    asked = F.struct(
        F.transform("columns", lambda c: F.struct(c["x"].alias("x"), c["right"].alias("right"), (c["label"].rlike(layout.CODE_TITLE) & ~c["label"].rlike(layout.QUANTITY_TITLE) & ~c["label"].rlike(layout.MONEY_TITLE)).alias("coded"))).alias("columns"),
        F.col("edges").alias("printed"), "char_width", "n_items",
        F.transform(F.flatten(F.transform(F.filter("lines", lambda l: l["told"].isNotNull()), lambda l: l["told"])), lambda f: F.struct(f["own"]["x"].alias("x"), f["own"]["right"].alias("right"), f["own"]["figure"].alias("figure"), f["own"]["decimal"].alias("decimal"), f["own"]["words"].alias("words"), f["own"]["lettered"].alias("lettered"), f["own"]["ink"].alias("ink"), f["parts"].alias("parts"))).alias("fields"),
        layout.coverage(F.flatten(F.transform(F.filter("lines", lambda l: l["spans"].isNotNull()), lambda l: l["spans"]))).alias("coverage"),
    )
    moved = layout.settle_edges(tables.where(F.col("titled") & (F.col("n_items") > 0)).select(*KEYS, asked.alias("asked")), KEYS)
    moved = moved.groupBy(*PAGE).agg(F.map_from_entries(F.collect_list(F.struct("nth", "edges"))).alias("moved"))
    lean = F.transform("lines", lambda l: F.struct(*(l[c].alias(c) for c in [*LINE, "item"])))
    edges = F.coalesce(F.try_element_at("moved", "nth"), "edges")
    return tables.join(moved, PAGE, "left").select(*KEYS, "line_height", "columns", "titled", "printed", edges.alias("edges"), "char_width", "n_items", lean.alias("lines"))


def guessed(tables: DataFrame) -> DataFrame:
    """Tables without items, read again under the widest gaps of the whole body's ink; those that stay without keep their edges."""
    spans = F.flatten(F.transform("lines", lambda l: F.transform(F.flatten(l["fields"]), lambda w: F.struct(w["x"].alias("lo"), right(w).alias("hi")))))
    guess = tables.withColumn("printed", layout.gutter_bounds(spans, F.col("columns"), F.col("edges"), F.col("line_height"))).drop("edges")
    return with_items(guess, "printed").where("n_items > 0")


def learned(tables: DataFrame) -> DataFrame:
    """Tables with their settled edges and what each column holds (null where no item filled it)."""
    read = with_items(tables, "printed")
    if "title" in tables.columns:  # printed titles: values may be set right of them, two columns in one cell
        lacking = F.col("n_items") == 0
        read = at_rest(read)
        if not read.where(lacking).isEmpty():
            again = at_rest(guessed(read.where(lacking)))
            read = read.join(again.select(*KEYS), KEYS, "left_anti").unionByName(again)
    df = settled(read)
    cell = lambda b: F.when(F.size(b) > 0, F.struct(F.array_min(F.transform(b, lambda w: w["x"])).alias("x"), F.array_max(F.transform(b, right)).alias("right"), layout.join_words(b).alias("text")))
    lines = _as_lines(df, "edges", "char_width", "n_items").withColumn("cols", F.when(F.col("item"), F.transform(_cells("edges"), cell)))
    df = _as_tables(lines, [*LINE, "item", "cols"], "edges", "char_width", "n_items")
    rows = F.transform(F.filter("lines", lambda l: l["item"]), lambda l: l["cols"])
    seen = layout.profiles(rows, F.col("columns"), F.col("char_width"))
    lean = F.transform("lines", lambda l: F.struct(*(l[c].alias(c) for c in [*LINE, "item"])))
    reach = F.least(F.col("line_height") * 1.5, layout.typical_gap(F.col("lines"), F.col("line_height")) + F.col("line_height") * 0.75)
    none = F.array().cast(f"array<{layout.PROFILE}>")
    return df.select(*KEYS, "line_height", "columns", "titled", "edges", "char_width", F.when(F.col("n_items") > 0, seen).otherwise(none).alias("profiles"), reach.alias("reach"), lean.alias("lines"))


def judged_lines(tables: DataFrame) -> DataFrame:
    """Each line of learned tables with its cells and what it is by itself.

    kind: item, furniture, rule, repeated-header, summary, label, starred, or loose; a loose line has
    ``placed`` (text, figures or null) and ``lead``, whether it can be a name printed above its item.
    """
    lines = _as_lines(tables, "edges", "char_width", "profiles", "reach")
    raw = lines.withColumn("raw", F.transform(_cells("edges"), layout.join_words))
    raw = raw.withColumn("notes", F.flatten(F.transform("raw", T.stock_notes))).withColumn("cells", F.transform("raw", T.without_stock_notes))
    said = F.array_join(F.col("cells"), " ")
    item = T.is_line_item(F.col("cells"))
    raw = raw.withColumn("item", item).withColumn("kind", (
        F.when(~F.col("item") & T.is_furniture(said), "furniture").when(T.is_rule(said), "rule").when(T.is_repeated_header(F.col("cells"), F.transform("columns", lambda c: c["label"])), "repeated-header")
        .when(F.trim(said) == "", "rule").when(T.is_summary(F.col("cells"), F.col("item")), "summary").when(F.col("item"), "item").otherwise("loose")))
    loose = layout.settle_overflow(_cells("edges", "profiles"), F.col("profiles"), F.col("char_width"))
    raw = raw.withColumn("loose", F.when(F.col("kind") == "loose", loose))
    own = F.transform("loose", lambda b: F.when(F.exists(b, lambda w: T.is_inked(w["text"])), layout.join_words(b)).otherwise(""))
    raw = raw.withColumn("placed", layout.place_line(F.col("loose"), F.col("profiles"), F.col("char_width"))).withColumn("cells", F.coalesce(own, "cells"))
    text = F.array_join(F.filter("cells", lambda c: c != ""), " ")
    starred = T.is_starred(text)
    kind = F.when((F.col("kind") == "loose") & starred, F.when((F.col("placed") == "text") & text.rlike("[A-Za-z]"), "label").otherwise("starred")).otherwise(F.col("kind"))
    return raw.select(*KEYS, "line_height", "columns", "titled", "edges", "reach", "top", "line_id", "bottom", "left", "confidence", "notes", "cells", kind.alias("kind"), "placed", ((F.col("placed") == "text") & T.is_lead_in(F.col("cells"))).alias("lead"))


STATE = "struct<row: int, prior: double, lead: int, lead_bottom: double, leads: int, out: array<struct<line_id: bigint, act: string, grp: int, lead: int>>>"


def _fold(lines: Column, reach: Column) -> Column:
    """What becomes of each line, from the top: array of struct<line_id, act, grp, lead>.

    The state holds the last row and where it ends (null once a total or a label came), and
    the name that waits for its item. act: row (opens row grp; ``lead`` names the waiting name it takes), wrap
    (goes on in row grp), lead (name number grp) or out.
    """
    null = F.lit(None).cast("double")

    def step(s: Column, l: Column) -> Column:
        follows = F.coalesce((s["row"] >= 0) & (l["top"] - s["prior"] <= reach), F.lit(False))
        near = F.coalesce((s["lead"] >= 0) & (l["top"] - s["lead_bottom"] <= reach), F.lit(False))

        def to(act: str, grp: Column, row: Column, prior: Column, lead: Column, lead_bottom: Column, leads: Column | None = None, takes: Column | None = None) -> Column:
            entry = F.struct(l["line_id"].alias("line_id"), F.lit(act).alias("act"), grp.cast("int").alias("grp"), (F.lit(-1) if takes is None else takes).cast("int").alias("lead"))
            return F.struct(row.alias("row"), prior.alias("prior"), lead.alias("lead"), lead_bottom.alias("lead_bottom"), (s["leads"] if leads is None else leads).alias("leads"), F.concat(s["out"], F.array(entry)).alias("out")).cast(STATE)

        none, nxt = F.lit(-1), s["row"] + 1
        loose = l["kind"] == "loose"
        return (
            F.when(l["kind"].isin("furniture", "rule", "repeated-header"), to("out", none, s["row"], s["prior"], s["lead"], s["lead_bottom"]))
            .when(l["kind"].isin("summary", "starred"), to("out", none, s["row"], null, none, null))
            .when(l["kind"] == "label", to("row", nxt, nxt, null, none, null))
            .when(loose & follows & (l["placed"] == "text"), to("wrap", s["row"], s["row"], F.greatest(s["prior"], l["bottom"]), s["lead"], s["lead_bottom"]))
            .when(loose & follows & (l["placed"] == "figures"), to("row", nxt, nxt, l["bottom"], s["lead"], s["lead_bottom"]))
            .when(loose & l["lead"] & near, to("lead", s["lead"], s["row"], s["prior"], s["lead"], l["bottom"]))
            .when(loose & l["lead"], to("lead", s["leads"], s["row"], s["prior"], s["leads"], l["bottom"], s["leads"] + 1))
            .when(loose, to("out", none, s["row"], s["prior"], none, null))
            .otherwise(to("row", nxt, nxt, l["bottom"], none, null, takes=F.when(near, s["lead"]).otherwise(none)))
        )

    start = F.struct(F.lit(-1).alias("row"), null.alias("prior"), F.lit(-1).alias("lead"), null.alias("lead_bottom"), F.lit(0).alias("leads"), F.array().cast("array<struct<line_id: bigint, act: string, grp: int, lead: int>>").alias("out")).cast(STATE)
    return F.aggregate(lines, start, step)["out"]


def folded(lines: DataFrame) -> DataFrame:
    """Judged lines with ``act`` (row, wrap, lead or out) and ``grp``: the row of its table that a line belongs to, or the name that found none."""
    kept = ["top", "line_id", "bottom", "left", "confidence", "notes", "cells", "kind", "placed", "lead"]
    tables = lines.groupBy(*KEYS).agg(*(F.first(c).alias(c) for c in ("columns", "titled", "edges", "reach")), F.sort_array(F.collect_list(F.struct(*kept))).alias("lines"))
    tables = tables.withColumn("acts", let(F.col("reach"), lambda r: _fold(F.col("lines"), r)))
    both = tables.select(*KEYS, "columns", "titled", "edges", F.explode(let(F.struct("lines", "acts"), lambda k: F.transform(k["lines"], lambda l, i: F.struct(l.alias("l"), at(k["acts"], i).alias("a"), F.filter(k["acts"], lambda o: (o["lead"] >= 0) & (o["lead"] == at(k["acts"], i)["grp"])).alias("taken"))))).alias("e"))
    named = (F.col("e.a.act") == "lead") & (F.size("e.taken") > 0)
    return both.select(*KEYS, "columns", "titled", "edges", "e.l.*", F.when(named, "name").otherwise(F.col("e.a.act")).alias("act"), F.when(named, at(F.col("e.taken"), 0)["grp"]).otherwise(F.col("e.a.grp")).alias("grp")).drop("lead")


def _joined(lines: Column) -> Column:
    """Cells of lines as one row's cells, column by column, in order."""
    both = lambda a, b: F.concat_ws(" ", F.nullif(F.trim(a), F.lit("")), F.nullif(F.trim(b), F.lit("")))
    return F.aggregate(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), at(lines, 0)["cells"], lambda acc, l: F.zip_with(acc, l["cells"], both))


def read_tables(words: DataFrame) -> DataFrame:
    """(doc, page, nth, title, headers, bounds, titled, top, body_left, rows, skipped): every column table of every page.

    rows: struct<row, cells, confidence, label>, from 0; skipped: struct<y, x, reason, text, confidence>, from the top.
    A further header with nothing but labels under it is no table: its lines, titles included,
    are left out by the page's first. Pages without titles give one table under the last
    edges of their document, if any line reads as an item there.

    Nulls and empty texts among the words take no part; an empty table gives an empty one.
    """
    pages = page_lines(words)
    heads = at_rest(titled_tables(pages))
    own = at_rest(learned(heads))
    last = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    first = own.where("nth = 0").select(*PAGE, F.struct(F.transform("columns", lambda c: c["label"]).alias("headers"), "edges").alias("guide"))
    guides = pages.select(*PAGE).join(first, PAGE, "left").select(*PAGE, F.col("guide").isNull().alias("bare"), F.last("guide", ignorenulls=True).over(last).alias("guide"))
    bare = pages.join(guides.where("bare AND size(guide.headers) >= 3"), PAGE)
    under = let(F.col("guide"), lambda g: F.transform(g["headers"], lambda h, i: F.struct(at(g["edges"], i).alias("x"), F.coalesce(at(g["edges"], i + 1), at(g["edges"], i)).alias("right"), h.alias("label"))))
    inherited = learned(bare.select(*PAGE, F.lit(0).alias("nth"), "line_height", under.alias("columns"), F.col("guide.edges").alias("printed"), F.lit(False).alias("titled"), "lines"))
    acts = folded(judged_lines(own.unionByName(inherited)))
    line = F.struct("top", "line_id", "left", "confidence", "cells", "kind", "act")
    groups = acts.where("act <> 'out'").groupBy(*KEYS, (F.col("act") == "lead").alias("waits"), "grp").agg(F.sort_array(F.collect_list(line)).alias("ls"))
    opener = F.filter("ls", lambda l: l["act"] == "row")
    groups = groups.withColumn("cells", _joined(F.col("ls"))).withColumn("opener", at(opener, 0))
    row = F.when(~F.col("waits"), F.struct(F.col("grp").alias("row"), "cells", F.col("opener.confidence").alias("confidence"), (F.col("opener.kind") == "label").alias("label"), F.col("opener.left").alias("left"), (F.col("opener.kind") == "item").alias("item")))
    two = lambda cells: F.array_join(F.filter(F.transform(cells, F.trim), lambda c: c != ""), "  ")
    skip = lambda y, x, reason, text, confidence: F.struct(y.alias("y"), x.alias("x"), reason.alias("reason"), text.alias("text"), confidence.alias("confidence"))
    unplaced = F.lit("unplaced")
    waiting = F.when(F.col("waits"), skip(at(F.col("ls"), 0)["top"], F.array_min(F.transform("ls", lambda l: l["left"])), unplaced, two("cells"), F.array_min(F.transform("ls", lambda l: l["confidence"]))))
    out = F.when(F.col("kind").isin("furniture", "repeated-header", "summary"), F.col("kind")).otherwise(unplaced)
    lost = F.when((F.col("act") == "out") & (F.col("kind") != "rule"), F.array(skip(F.col("top"), F.col("left"), out, two("cells"), F.col("confidence")))).otherwise(F.array())
    notes = F.transform("notes", lambda n: skip(F.col("top"), F.col("left"), F.lit("note"), n, F.col("confidence")))
    kind = "struct<y: double, x: double, reason: string, text: string, confidence: double>"
    left_out = acts.select(*KEYS, "columns", "edges", "titled", F.lit(None).cast(row_kind := "struct<row: int, cells: array<string>, confidence: double, label: boolean, left: double, item: boolean>").alias("row"), F.filter(F.concat(notes.cast(f"array<{kind}>"), lost.cast(f"array<{kind}>")), lambda s: s["text"] != "").alias("skips"))
    made = groups.select(*KEYS, F.lit(None).cast(acts.schema["columns"].dataType).alias("columns"), F.lit(None).cast("array<double>").alias("edges"), F.lit(None).cast("boolean").alias("titled"), row.cast(row_kind).alias("row"), F.filter(F.array(waiting.cast(kind)), lambda s: s.isNotNull()).alias("skips"))
    tables = left_out.unionByName(made).groupBy(*KEYS).agg(
        F.first("columns", ignorenulls=True).alias("columns"), F.first("edges", ignorenulls=True).alias("bounds"), F.first("titled", ignorenulls=True).alias("titled"),
        F.sort_array(F.collect_list("row")).alias("rows"), F.array_sort(F.flatten(F.collect_list("skips"))).alias("skipped"))
    # a header without a line under it is a table without rows
    top = heads.select(*KEYS, "title", "top", F.col("columns").alias("own_columns"), "printed")
    tables = tables.join(top, KEYS, "full").withColumn("columns", F.coalesce("columns", "own_columns"))
    priced = F.exists("rows", lambda r: ~r["label"])
    tables = tables.withColumn("kept", F.coalesce(priced, F.lit(False)) | ((F.col("nth") == 0) & F.coalesce("titled", F.lit(True))))
    labels = F.transform("columns", lambda c: c["label"])
    titles = F.array(skip(F.col("top"), F.lit(0.0), unplaced, F.array_join(labels, "  "), F.lit(1.0))).cast(f"array<{kind}>")
    orphans = F.transform("rows", lambda r: skip(F.col("top"), F.lit(0.0), unplaced, F.array_join(F.filter(r["cells"], lambda c: F.trim(c) != ""), "  "), r["confidence"])).cast(f"array<{kind}>")
    empty = F.array().cast(f"array<{kind}>")
    owed = F.when(~F.col("kept") & (F.col("nth") > 0), F.concat(titles, F.coalesce(orphans, empty), F.coalesce("skipped", empty))).otherwise(empty)
    page = Window.partitionBy(*PAGE)
    tables = tables.withColumn("owed", F.flatten(F.collect_list(owed).over(page))).where("kept")
    skipped = F.array_sort(F.concat(F.coalesce("skipped", empty), F.when(F.col("nth") == 0, F.col("owed")).otherwise(empty)))
    lefts = F.transform(F.filter("rows", lambda r: r["item"]), lambda r: r["left"])
    slim = F.transform(F.coalesce("rows", F.array().cast(f"array<{row_kind}>")), lambda r: F.struct(r["row"].alias("row"), r["cells"].alias("cells"), r["confidence"].alias("confidence"), r["label"].alias("label")))
    return tables.select(*KEYS, F.trim("title").alias("title"), labels.alias("headers"), F.coalesce("bounds", "printed").alias("bounds"), F.coalesce("titled", F.lit(True)).alias("titled"), layout.median(lefts).alias("body_left"), slim.alias("rows"), skipped.alias("skipped"))


def read_rows(tables: DataFrame) -> DataFrame:
    """(doc, page, nth, headers, row, cells, confidence, label) of read tables."""
    return tables.select(*KEYS, "headers", F.explode("rows").alias("r")).select(*KEYS, "headers", "r.*")


def left_out(tables: DataFrame) -> DataFrame:
    """(doc, page, reason, text, confidence, y, x): every line that no row took, and why."""
    return tables.select(*PAGE, F.explode("skipped").alias("s")).select(*PAGE, "s.reason", "s.text", "s.confidence", "s.y", "s.x")
