"""Sharding by longest processing time: groups of equal texts, largest first, to the least-loaded shard.

1. Rows get their size and the SHA-256 of their text; sizes add up by text, combined
   before the shuffle, so a text with very many copies is one row a task there.
2. A group of more than 1 / (``LARGE`` x shards) of all bytes is a unit of its own: there
   are at most ``LARGE`` x shards of them. All others lie, by their hash, in ``BINS`` x
   shards bins, each a unit. Units are as many at a hundred terabytes as at one gigabyte,
   at most (``LARGE`` + ``BINS``) x shards, and no unit but a single large group exceeds a
   small part of a shard.
3. Units sorted by size go to the least-loaded shard through a heap; the plan is
   broadcast, and rows find their shard by hash without a shuffle.
4. Slots: rows are numbered within (shard, partition they lie in), on top of the counts of
   the partitions before; no shard is gathered in one task.

The law is ``bytes``: shards differ by about the smallest units, unless one group alone
exceeds a shard's share, which stays together all the same.

Edge cases: a null text counts as empty (size 1, checksum 0) and shares their group.
Repeated rows get a slot each. Texts of any length are read whole. Null ids are rows like
others. Ties between units go by their key, between shards by their number. An empty
table gives an empty one. Columns of the input that have a result column's name are replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SHARDS = 16
LARGE, BINS = 256, 1024


def longest_first(units: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Shard of each (size, key): largest first, ties by key, each to the shard with the least load so far."""
    loads = [(0, s) for s in range(shards)]
    placed = {}
    for size, key in sorted(units, key=lambda u: (-u[0], u[1])):
        load, s = loads[0]
        placed[key] = s
        heapq.heapreplace(loads, (load + size, s))
    return placed


def number_rows(df: DataFrame, key: str) -> DataFrame:
    """``df`` (at rest, with ``mark`` from monotonically_increasing_id) with ``slot``: gapless from 0 within ``key``."""
    df = df.withColumn("_part", F.shiftright("mark", 33))
    counts = df.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    nth = F.row_number().over(Window.partitionBy(key, "_part").orderBy("mark")) - 1
    return df.withColumn("_nth", nth).join(base, [key, "_part"]).withColumn("slot", (F.col("_base") + F.col("_nth")).cast("long")).drop("_part", "_nth", "_base")


def shard(docs: DataFrame, shards: int = SHARDS, text_col: str = "text") -> DataFrame:
    """``docs`` without texts, with size, text_crc32, shard and slot."""
    made = {"size", "text_crc32", "shard", "slot", text_col.lower()}
    names = [c for c in docs.columns if c.lower() not in made]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = cut(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names] or [F.lit(0)]).alias("kept"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("digest"), F.monotonically_increasing_id().alias("mark"),
    ))
    total = rows.agg(F.sum("size")).first()[0] or 0
    bin_of = F.concat(F.lit("bin "), F.pmod(F.xxhash64("digest"), F.lit(BINS * shards)).cast("string"))
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"))
    large = F.col("size") * (LARGE * shards) > total
    units = groups.groupBy(F.when(large, F.col("digest")).otherwise(bin_of).alias("unit")).agg(F.sum("size").alias("size"))
    plan = longest_first([(r["size"], r["unit"]) for r in units.collect()], shards)  # at most (LARGE + BINS) x shards units
    spark = docs.sparkSession
    own = F.broadcast(spark.createDataFrame([(u, s) for u, s in plan.items() if not u.startswith("bin ")], "digest string, own int"))
    bins = F.broadcast(spark.createDataFrame([(u, s) for u, s in plan.items() if u.startswith("bin ")], "bin string, dealt int"))
    placed = rows.join(own, "digest", "left").withColumn("bin", bin_of).join(bins, "bin", "left").withColumn("shard", F.coalesce("own", "dealt"))
    return number_rows(placed.select("kept", "size", "text_crc32", "shard", "mark"), "shard").select(*[F.col(f"kept.`{c}`") for c in names], "size", "text_crc32", "shard", "slot")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
