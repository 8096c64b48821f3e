"""Duplicate removal: first seen per key, and within a time window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dqstream.plans.stage import stage

# Keys with more distinct times than this are chained by doubling steps over
# rows; the others by a fold over one short array.
FOLD_LIMIT = 4096
# Where such a key's times meet, they meet in slots of this length whatever the
# window is: at most 60,000 instants and as many probes in a slot, and one row a
# minute for the key.
SLOT_MS = 60_000


def first_seen(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key.

    `row_number() = 1` is taken per task before the shuffle too, so a hot key
    sends one row per task.
    """
    ranked = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(ranked)).filter("__rn = 1").drop("__rn")


def dedup_window(
    df: DataFrame,
    key: str,
    time: str,
    order: str | Sequence[str],
    seconds: int,
    seen: DataFrame | None = None,
    fold_limit: int = FOLD_LIMIT,
) -> DataFrame:
    """Rows accepted when a key may come again after `seconds`.

    A row is a duplicate if its key was accepted at most `seconds` before it;
    duplicates do not prolong the window. `time` is epoch milliseconds and
    `order`, one or more columns unique within the table, parts rows of equal time. `seen` may hold
    (key, time) accepted earlier, one row per key.

    The rejected rows are found from narrow columns and only for keys that come
    more than once, then taken out by an anti join.
    """
    rejected = rejected_rows(df, key, time, order, seconds, seen, fold_limit)
    return df.join(rejected, rejected.columns, "left_anti")


def rejected_rows(
    df: DataFrame,
    key: str,
    time: str,
    order: str | Sequence[str],
    seconds: int,
    seen: DataFrame | None = None,
    fold_limit: int = FOLD_LIMIT,
) -> DataFrame:
    """The `order` values of the rows `dedup_window` leaves out."""
    gap = seconds * 1000
    parts = [order] if isinstance(order, str) else list(order)
    place = F.col(parts[0]) if len(parts) == 1 else F.struct(*parts)
    narrow = df.select(F.col(key).alias("k"), F.col(time).alias("t"), place.alias("o"))
    # `o` is null for an acceptance of an earlier run.
    pool = narrow
    if seen is not None:
        earlier = seen.select(
            F.col(key).alias("k"), F.col(time).alias("t"), F.lit(None).cast(narrow.schema["o"].dataType).alias("o")
        )
        pool = narrow.unionByName(earlier)
    # Only keys with several rows can hold a duplicate; most have one.
    repeated = stage(pool.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k"))
    if repeated.isEmpty():
        return df.select(*parts).filter(F.lit(False))
    candidates = stage(pool.join(repeated, "k", "left_semi"))
    instants = candidates.groupBy("k", "t").agg(
        F.min("o").alias("first_o"), F.count_if(F.col("o").isNull()).alias("old")
    )
    # Keys are parted by their number of instants, not by their rows.
    sizes = stage(instants.groupBy("k").agg(F.count(F.lit(1)).alias("times")))
    large = sizes.filter(F.col("times") > fold_limit).select("k")
    if large.isEmpty():
        accepted = _chain_by_fold(instants, gap)
    else:
        small = sizes.filter(F.col("times") <= fold_limit).select("k")
        accepted = _chain_by_fold(instants.join(small, "k", "left_semi"), gap).unionByName(
            _chain_by_doubling(stage(instants.join(large, "k", "left_semi")), gap)
        )
    kept = accepted.filter("old = 0").select("k", F.col("first_o").alias("o"))
    fresh = candidates.filter(F.col("o").isNotNull())
    out = fresh.join(kept, ["k", "o"], "left_anti")
    if len(parts) == 1:
        return out.select(F.col("o").alias(parts[0]))
    return out.select(*[F.col(f"o.{c}").alias(c) for c in parts])


def _chain_by_fold(instants: DataFrame, gap: int) -> DataFrame:
    """Accepted instants per key by walking the key's short sorted array."""

    def step(done: Column, item: Column) -> Column:
        last = F.element_at(done, -1)
        return F.when((F.size(done) == 0) | (item["t"] > last["t"] + gap), F.concat(done, F.array(item))).otherwise(
            done
        )

    items = F.sort_array(F.collect_list(F.struct("t", "first_o", "old")))
    return (
        instants.groupBy("k")
        .agg(items.alias("items"))
        .select("k", F.inline(F.aggregate("items", F.slice("items", 1, 0), step)))
    )


def _chain_by_doubling(instants: DataFrame, gap: int) -> DataFrame:
    """Accepted instants of keys with many times, without gathering a key.

    Each instant points to the first one more than `gap` later. From a key's
    first instant, the reached set is doubled per round: the 2^i-step pointers
    of all reached instants join it. At most one instant per window of length
    `gap` is reached, so log2(time range / gap) rounds suffice. All joins are
    on (key, instant), which spreads a hot key over all tasks.
    """
    links = stage(_next_instants(instants, gap))
    reached = stage(instants.groupBy("k").agg(F.min("t").alias("t")))
    while True:
        step = reached.join(links, ["k", "t"]).select("k", F.col("nxt").alias("t")).filter("t IS NOT NULL")
        grown = stage(reached.unionByName(step).distinct())
        if grown.count() == reached.count():
            break
        reached = grown
        # Twice the stride: follow the pointer of the pointed-to instant.
        onward = links.select("k", F.col("t").alias("nxt"), F.col("nxt").alias("far"))
        links = stage(links.filter("nxt IS NOT NULL").join(onward, ["k", "nxt"]).select("k", "t", F.col("far").alias("nxt")))
    return instants.join(reached, ["k", "t"]).select("k", "t", "first_o", "old")


def _next_instants(instants: DataFrame, gap: int) -> DataFrame:
    """For each (key, time), the key's first time greater than time + gap.

    The answer lies in the slot of `time + gap` or is the first time of a later
    slot. Rows meet per (key, slot), which holds at most one row per distinct
    millisecond; one row per slot meets per key.
    """
    probes = instants.select("k", (F.col("t") + gap).alias("at"), F.col("t").alias("src"))
    marks = instants.select("k", F.col("t").alias("at"), F.col("t").alias("hit"))
    mixed = probes.unionByName(marks, allowMissingColumns=True).withColumn("slot", F.expr(f"at div {SLOT_MS}L"))
    # Backwards, so that the frame grows from row to row.
    ahead = W.partitionBy("k", "slot").orderBy(F.desc("at")).rangeBetween(W.unboundedPreceding, -1)
    inside = mixed.withColumn("near", F.min("hit").over(ahead)).filter("src IS NOT NULL")
    slots = mixed.groupBy("k", "slot").agg(F.min("hit").alias("first_hit"))
    later = W.partitionBy("k").orderBy(F.desc("slot")).rowsBetween(W.unboundedPreceding, -1)
    beyond = slots.select("k", "slot", F.min("first_hit").over(later).alias("next_hit"))
    return inside.join(beyond, ["k", "slot"]).select(
        "k", F.col("src").alias("t"), F.coalesce("near", "next_hit").alias("nxt")
    )


def dedup_stream(df: DataFrame, key: str, event_time: str, seconds: int) -> DataFrame:
    """Built-in streaming dedup for a plain stream.

    State expires by watermark, so a key is blocked for at least `seconds`;
    `dedup_window` with `seen` gives the exact window inside a micro-batch.
    """
    return df.withWatermark(event_time, f"{seconds} seconds").dropDuplicatesWithinWatermark([key])
