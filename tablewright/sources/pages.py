"""Where pages come from: files by their first bytes, posted page JSON, raw word boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes that a corpus folder is searched for.
SUFFIXES = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "webp")
TABLE = "struct<title:string,headers:array<string>,rows:array<array<string>>>"
POSTED = f"page int, kind string, title string, headers array<string>, rows array<struct<cells:array<string>,confidence:double>>, tables array<{TABLE}>, skipped array<struct<reason:string,text:string,confidence:double>>"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, is_pdf) of the files of a folder."""
    glob = "*.{" + ",".join(SUFFIXES) + "}"
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return found.select("path", "length", "content", (F.expr("substring(content, 1, 5)") == F.expr("X'255044462D'")).alias("is_pdf"))


def posted_pages(posts: DataFrame, json_col: str = "body") -> DataFrame:
    """Page JSON as export pages: (doc, page, kind, title, headers, rows, tables, skipped); kind defaults to table."""
    page = F.from_json(json_col, POSTED)
    rows = posts.select("doc", page.alias("p")).select("doc", "p.*")
    return rows.withColumn("kind", F.coalesce("kind", F.lit("table"))).withColumn("rows", F.coalesce(F.transform("rows", lambda r: r["cells"]), F.array().cast("array<array<string>>")))


def scaled_words(boxes: DataFrame, dpi: float = 200.0) -> DataFrame:
    """Words of text-layer boxes in points: scaled to pixels, blank ones dropped, sizes of at least 1."""
    k = dpi / 72
    sized = {c: F.col(c) * k for c in ("x", "y")} | {c: F.greatest(F.col(c) * k, F.lit(1.0)) for c in ("width", "height")}
    return boxes.where(F.trim("text") != "").withColumns(sized | {"confidence": F.lit(1.0)})


def usable_pages(words: DataFrame) -> DataFrame:
    """(doc, page) whose text layer has 8 words and 40 letters or digits at least."""
    letters = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    return words.groupBy("doc", "page").agg(F.count("*").alias("n"), F.sum(letters).alias("letters")).where("n >= 8 AND letters >= 40").select("doc", "page")
