"""Line dedup with a log-template tree of fixed depth.

A line's tokens are its words; a token with a digit becomes ``<*>``. The tree sorts
lines by token count, then by their first ``DEPTH`` tokens. In a leaf, a token stays
fixed where enough of the leaf's lines have it at its place and becomes ``<*>`` where
fewer do; ``LEVELS`` holds the shares, from the line as it is to the most general form.
So a line has one template a level, whatever other lines there are and in whatever
order they come. A template is boilerplate if it keeps ``CONSTANT`` fixed tokens, at most
1 - ``SIMILARITY`` of its tokens are generalised, and it occurs in ``min_docs``
documents; a line of over ``LONG`` words that is the same in two documents is, too. The
most general template that is boilerplate decides: its lines go from every document but
the one with the smallest id, so that a text which only copies share is not lost
(``keep_one=False`` drops them everywhere).

On Spark: a first pass counts documents by leaf; only lines of leaves that enough
documents share can recur, so only they travel. Fixed tokens are counted by leaf, place
and token, and each place keeps at most 1 / share of them, so what a leaf knows is
bounded by its lines' length; it meets the leaf's lines in salted groups. Leaves, and the
recurring lines with their keepers, are broadcast while they are few (their count is
checked), else joined by a shuffle; results are the same.

Documents with the same id count as one; null ids count as one document of their own,
which is never the one that keeps. Null texts stay null; empty lines and lines of fewer
than ``CONSTANT`` tokens always stay; lines of any length are read whole. A document of
which all lines go keeps an empty text. An empty table gives an empty table. Columns of
the input that have a result column's name are replaced; other names may be anything.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK_BYTES, blocks, cut, table

DEPTH = 3
SIMILARITY = 0.7
CONSTANT = 3
MIN_DOCS = 3
#: Words beyond which a line that is the same in two documents recurs.
LONG = 50
#: Shares of a leaf's lines from which a token stays fixed, by level; 0 is the line as it is.
LEVELS = (0.0, 1 / 16, 1 / 2)
#: Distinct lines of one leaf that meet what the leaf knows in one group, about.
DEALT = 2000
#: Leaves whose hashes may be broadcast (8 bytes each).
FEW_LEAVES = 400_000
#: Recurring lines that may be broadcast with their keepers (16 bytes each).
FEW_LINES = 400_000
WILD = "<*>"
_DIGIT = re.compile(r"\d").search
#: Stands for a null id; larger than any real one, so it never keeps.
NO_ID = (1 << 63) - 1


def mask(line: str) -> list[str]:
    words = line.split()
    return [WILD if _DIGIT(w) else w for w in words] if _DIGIT(line) else words


def hash_of(text: str) -> int:
    """64 bits, signed."""
    import xxhash

    h = xxhash.xxh64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def leaf_of(tokens: list[str], depth: int) -> int:
    return hash_of(f"{len(tokens)} " + " ".join(tokens[:depth]))


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's distinct leaves, and those of its long lines."""
    for batch in batches:
        for part in blocks(batch, "text", BLOCK_BYTES):
            out: list[tuple[int, bool]] = []
            for text in part.column("text").to_pylist():
                if text:
                    masked = (mask(line) for line in set(text.split("\n")))
                    out += {(leaf_of(t, DEPTH), len(t) > LONG) for t in masked if len(t) >= CONSTANT}
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.bool_())], ["leaf", "long"])


def _salted_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct masked lines under its salt."""
    for batch in batches:
        for part in blocks(batch, "text", BLOCK_BYTES):
            for salt, text in zip(part.column("salt").to_pylist(), part.column("text").to_pylist(), strict=True):
                got = {hash_of(" ".join(t)) for t in map(mask, (text or "").split("\n")) if len(t) >= CONSTANT}
                yield pa.RecordBatch.from_arrays([pa.array([salt] * len(got), pa.int64()), pa.array(got, pa.int64())], ["salt", "line"])


LINES = "doc long, leaf long, line long, masked string"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's distinct masked lines."""
    for batch in batches:
        for part in blocks(batch, "text", BLOCK_BYTES):
            rows = []
            for doc, text in zip(part.column("doc").to_pylist(), part.column("text").to_pylist(), strict=True):
                for masked in {" ".join(t): t for t in map(mask, (text or "").split("\n")) if len(t) >= CONSTANT}.items():
                    rows.append((doc, leaf_of(masked[1], DEPTH), hash_of(masked[0]), masked[0]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc", "leaf", "line", "masked"])


def line_templates(distinct: DataFrame, min_docs: int) -> DataFrame:
    """(line, level, template, need) of distinct lines (leaf, line, masked, docs); templates that keep too little are left out.

    A leaf of one line, or of lines in fewer than ``min_docs`` documents together, has
    nothing to generalise: there only the lines themselves can recur.
    """
    sizes = distinct.groupBy("leaf").agg(F.sum("docs").alias("all"), F.count("*").alias("lines"))
    sizes = cut(sizes.where((F.col("lines") > 1) & (F.col("all") >= min_docs)).withColumn("groups", (F.col("lines") / DEALT).cast("int") + 1))
    open_ = cut(distinct.join(sizes, "leaf"))
    counted = open_.select("leaf", "docs", "all", F.posexplode(F.split("masked", " ")).alias("place", "token")).groupBy("leaf", "place", "token").agg(F.sum("docs").alias("n"), F.first("all").alias("all"))
    seen = counted.select("leaf", "place", F.when((F.col("n") >= F.col("all") * LEVELS[1]) & (F.col("token") != WILD), F.struct("token", (F.col("n") / F.col("all")).alias("share"))).alias("x"))
    known = seen.groupBy("leaf", "place").agg(F.collect_list("x").alias("fixed"))  # at most 1 / share a place
    profile = known.groupBy("leaf").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "fixed"))), lambda x: x["fixed"]).alias("profile"))
    dealt = profile.join(sizes.select("leaf", "groups"), "leaf").select("leaf", "profile", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    met = open_.withColumn("group", F.pmod("line", "groups").cast("int")).join(dealt, ["leaf", "group"]).select("leaf", "line", F.split("masked", " ").alias("tokens"), "profile")

    def form(level: int) -> Column:
        fixed = lambda i: F.filter(F.col("profile")[i], lambda x: x["share"] >= LEVELS[level])["token"]
        return F.transform("tokens", lambda t, i: F.when((t == WILD) | F.array_contains(fixed(i), t), t).otherwise(WILD))

    forms = F.array(*(F.struct(F.lit(k).alias("level"), form(k).alias("made")) for k in range(1, len(LEVELS))))
    general = met.select("leaf", "line", "tokens", F.explode(forms).alias("x")).select("leaf", "line", "x.level", "x.made", "tokens")
    exact = distinct.select("leaf", "line", F.lit(0).alias("level"), F.split("masked", " ").alias("made")).withColumn("tokens", F.col("made"))
    named = lambda c: F.size(F.filter(c, lambda t: t != WILD))
    each = exact.unionAll(general).select("leaf", "line", "level", "made", F.size("tokens").alias("size"), named("tokens").alias("before"), named("made").alias("constants"))
    keeps = (F.col("constants") >= CONSTANT) & ((F.col("before") - F.col("constants")) <= (1 - SIMILARITY) * F.col("size"))
    need = F.when((F.col("level") == 0) & (F.col("size") > LONG), 2)
    return cut(each.where(keeps).select("line", "level", F.xxhash64("leaf", "level", F.array_join("made", " ")).alias("template"), need.alias("need")))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, keep_one: bool = True) -> DataFrame:
    """(line, keeper): hashes of the masked lines that recur, and the document that keeps each; docs: (doc, text)."""
    enough = F.when(F.col("long"), 2).otherwise(min_docs)
    leaves = cut(docs.select("text").mapInArrow(_leaves, "leaf long, long boolean").groupBy("leaf", "long").agg(F.count("*").alias("n")).where(F.col("n") >= enough).select("leaf"))
    shared = F.broadcast(leaves) if leaves.count() <= FEW_LEAVES else leaves
    lines = cut(docs.mapInArrow(_lines, LINES).join(shared, "leaf"))
    distinct = cut(lines.groupBy("leaf", "line").agg(F.min("masked").alias("masked"), F.count("*").alias("docs")))
    forms = line_templates(distinct, min_docs)
    held = lines.select("doc", "line").join(forms, "line").select("doc", "level", "template", "need").distinct()
    counted = held.groupBy("level", "template").agg(F.count("*").alias("n"), F.min("doc").alias("keeper"), F.min("need").alias("need"))
    found = cut(counted.where(F.col("n") >= F.coalesce("need", F.lit(min_docs))))  # a table of its own, so that the join can split a common template's rows
    best = forms.join(found.select("level", "template", "keeper"), ["level", "template"]).groupBy("line").agg(F.max(F.struct("level", "keeper"))["keeper"].alias("keeper"))
    return cut(best.select("line", F.col("keeper") if keep_one else F.lit(NO_ID).alias("keeper")))


def drop_recurring_lines(df: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", keep_one: bool = True) -> DataFrame:
    """``df`` with its texts without recurring lines, n_lines (before) and n_dropped."""
    new = {"n_lines", "n_dropped"}
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new])
    doc = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    keyed = base.select(F.struct("*").alias("row"), doc.alias("doc"), F.col(f"`{text_col}`").alias("text"))
    found = recurring_lines(keyed.select("doc", "text"), min_docs, keep_one)
    if found.count() <= FEW_LINES:
        got = found.toArrow().sort_by("line")  # bounded by the count
        known, keepers = got["line"].to_numpy(), got["keeper"].to_numpy()

        def gone(part: pa.RecordBatch, texts: list[str | None]) -> list[np.ndarray | None]:
            """For each text which of its lines go."""
            hashes = [[hash_of(" ".join(t)) if len(t := mask(x)) >= CONSTANT else None for x in text.split("\n")] if text else [] for text in texts]
            flat = np.array([h or 0 for hs in hashes for h in hs], np.int64)
            usable = np.array([h is not None for hs in hashes for h in hs], bool)
            at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
            of = np.repeat(part.column("doc").to_numpy(), [len(hs) for hs in hashes])
            hit = usable & (known[at] == flat) & ((keepers[at] != of) | (of == NO_ID)) if len(known) else np.zeros(len(flat), bool)
            return np.split(hit, np.cumsum([len(hs) for hs in hashes])[:-1]) if hashes else []

        rows = keyed
    else:
        # texts travel to the lists of their lines that go; the rows without an id get a key of their own each
        lines = keyed.select("doc", "text").mapInArrow(_lines, LINES).select("doc", "line").join(found, "line").where((F.col("doc") != F.col("keeper")) | (F.col("doc") == NO_ID))
        own = F.when(F.col("doc") != NO_ID, F.col("doc"))
        lists = lines.where(F.col("doc") != NO_ID).groupBy("doc").agg(F.collect_set("line").alias("gone"))
        nameless = keyed.where(own.isNull()).withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
        salted = nameless.select("salt", F.col("doc"), "text").mapInArrow(_salted_lines, "salt long, line long").join(found.select("line"), "line").groupBy("salt").agg(F.collect_set("line").alias("gone"))
        rows = keyed.where(own.isNotNull()).join(lists, "doc", "left").select("row", "doc", "text", "gone").unionAll(nameless.join(salted, "salt", "left").select("row", "doc", "text", "gone"))

        def gone(part: pa.RecordBatch, texts: list[str | None]) -> list[np.ndarray | None]:
            out: list[np.ndarray | None] = []
            for text, drop in zip(texts, part.column("gone").to_pylist(), strict=True):
                drop = set(drop or ())
                out.append(np.array([len(t := mask(x)) >= CONSTANT and hash_of(" ".join(t)) in drop for x in text.split("\n")], bool) if drop and text else None)
            return out

    made = T.StructType([T.StructField("row", keyed.schema["row"].dataType), T.StructField("left", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", BLOCK_BYTES):
                texts = part.column("text").to_pylist()
                left, total, dropped = [], [], []
                for text, hit in zip(texts, gone(part, texts), strict=True):
                    n = text.count("\n") + 1 if text else 0
                    k = int(hit.sum()) if hit is not None else 0
                    left.append("\n".join(x for x, h in zip(text.split("\n"), hit, strict=True) if not h) if k else text)
                    total.append(n)
                    dropped.append(k)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(left, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], made.names)

    out = rows.mapInArrow(apply, made)
    return out.select(*[F.col("left").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in base.columns], "n_lines", "n_dropped")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_recurring_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")
