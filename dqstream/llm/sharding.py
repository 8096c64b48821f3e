"""Sharding by extendible hashing, in DataFrame functions only.

A document's hash is 60 bits of the MD5 of its id and text. A bucket is a prefix
of hash bits; only a bucket above the byte limit splits on its next bit, until
each holds at most the limit or a single document. Documents are first reduced
to narrow rows (id, hash, bytes). Each round folds the rows of the buckets still
open to cells STEP bits further down, sums the cells up to every prefix between,
and settles each cell at its shortest prefix that fits; only documents of open
cells enter the next round. Sums are made before any shuffle, so a hot bucket
costs a row per task.

Defined results: a null text has no bytes; null ids and texts hash like their own
mark. Rows equal in id and text have one hash and cannot part by bits: where they
exceed the limit together they fill numbered pages of the last bucket. A single
document above the limit is a shard of its own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dqstream.plans.stage import stage

BITS = 60
STEP = 12
LIMIT = 1 << 20


def hash_of(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 as a BIGINT."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("\u0000null")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("bigint")


def bits(value: Column, depth: Column) -> Column:
    """A prefix written as text of 0 and 1; empty for no bits."""
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(value), depth, "0"))


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, shard (its hash prefix), depth, page, shard_bytes, shard_docs."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    rows = docs.select("doc_id", hash_of(F.col("doc_id"), F.col("text")).alias("h"), size.alias("n_bytes"))
    left = stage(rows.withColumn("row", F.monotonically_increasing_id()))
    placed: list[DataFrame] = []
    for top in range(0, BITS, STEP):
        low = top + STEP
        cells = stage(
            left.groupBy(F.expr(f"shiftrightunsigned(h, {BITS - low})").alias("cell"))
            .agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
        )
        depths = F.explode(F.sequence(F.lit(top if top == 0 else top + 1), F.lit(low))).alias("depth")
        above = cells.select("cell", "bytes", "docs", depths)
        above = above.withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {low} - depth)"))
        nodes = above.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
        fits = nodes.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
        # The shortest prefix that fits, for every cell.
        chosen = above.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"])
        best = chosen.groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("s"))
        best = stage(best.select("cell", "s.*"))
        keyed = left.withColumn("cell", F.expr(f"shiftrightunsigned(h, {BITS - low})"))
        placed.append(
            keyed.join(best, "cell").select(
                "doc_id", "n_bytes", bits(F.col("prefix"), F.col("depth")).alias("shard"), "depth",
                F.lit(0).cast("bigint").alias("page"), "shard_bytes", "shard_docs",
            )
        )
        rest = keyed.join(best.select("cell"), "cell", "left_anti").drop("cell")
        left = stage(rest)
        if left.isEmpty():
            break
    placed.append(_pages(left, limit))
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def _pages(same: DataFrame, limit: int) -> DataFrame:
    """Rows that all hash bits leave together: equal rows, so of equal size, in pages per part of the table."""
    part = F.shiftrightunsigned("row", 33).alias("part")
    inside = W.partitionBy("h", "part").orderBy("row")
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1)))).cast("bigint")
    numbered = same.select("*", part).withColumn("nth", F.row_number().over(inside) - 1)
    numbered = numbered.withColumn("each", each).withColumn("page", F.expr("shiftleft(part, 33) + nth div each"))
    held = W.partitionBy("h", "page")
    return numbered.select(
        "doc_id", "n_bytes", bits(F.col("h"), F.lit(BITS)).alias("shard"), F.lit(BITS).alias("depth"), "page",
        F.sum("n_bytes").over(held).alias("shard_bytes"), F.count(F.lit(1)).over(held).alias("shard_docs"),
    )


def directory(placed: DataFrame) -> DataFrame:
    """One row per shard, with the range of 60-bit hashes that leads to it."""
    shard = placed.groupBy("shard", "depth", "page").agg(
        F.min("shard_bytes").alias("shard_bytes"), F.min("shard_docs").alias("shard_docs")
    )
    padded = lambda end: F.conv(F.rpad("shard", BITS, end), 2, 10).cast("bigint")
    return shard.withColumn("first_hash", padded("0")).withColumn("last_hash", padded("1"))
