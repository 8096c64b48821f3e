"""Event volume against a rolling baseline, and stalls.

A batch is evaluated at its clock, the latest receive time so far. An event
counts from its own batch until the first batch whose clock has passed its
expiry, so volumes are running sums of arrivals minus expiries. Per batch the
events are folded to their distinct event times first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dqstream.contract import BATCH
from dqstream.plans.scan import SPAN, running, span_of, streaks, with_reach
from dqstream.plans.stage import stage
from dqstream.policy import Policy

# Expiries and clocks meet per minute: at most 60,000 distinct milliseconds of
# each, however many events there are.
SLOT_MS = 60_000


def tumbling(df: DataFrame, seconds: int) -> DataFrame:
    """Events per event-time bucket."""
    width = seconds * 1000
    return (
        df.groupBy("feed", F.expr(f"floor(occurred_at / {width}) * {width}").cast("bigint").alias("bucket_start"))
        .agg(F.count(F.lit(1)).alias("events"))
    )


def volume_grid(df: DataFrame) -> DataFrame:
    """Events per batch and distinct event time, with the latest receive time."""
    timed = df.filter(F.col("occurred_at").isNotNull())
    return timed.groupBy(*BATCH, "occurred_at").agg(
        F.count(F.lit(1)).alias("n"), F.max("received_at").alias("newest")
    )


def volumes(
    grid: DataFrame,
    p: Policy,
    initial: DataFrame | None = None,
    arrived: DataFrame | None = None,
    span: int | None = SPAN,
) -> DataFrame:
    """Per batch: clock, short-window volume and baseline total.

    `grid` is read several times: stage it. `initial` may hold the clock that
    an earlier run had reached, `arrived` staged (`arrived`, `newest`) per batch
    if they are known already.
    """
    short, base = p.short_window_seconds * 1000, p.baseline_window_seconds * 1000
    if arrived is None:
        arrived = stage(grid.groupBy(*BATCH).agg(F.sum("n").alias("arrived"), F.max("newest").alias("newest")))
        span = span_of(arrived) if span == SPAN else span
    clocks = stage(
        running(arrived, ["feed"], ["batch_id"], maxes={"clock": F.col("newest")}, initial=initial, span=span)
    )

    # First instant at which an event no longer counts. A bucket goes when its
    # end is a whole short window old, a baseline event when it is more than
    # the baseline old.
    bucket_end = F.expr(f"(floor(occurred_at / {short}) + 1) * {short}").cast("bigint")
    ends = F.array(
        F.struct(F.lit("short").alias("kind"), (bucket_end + short).alias("at")),
        F.struct(F.lit("base").alias("kind"), (F.col("occurred_at") + base + 1).alias("at")),
    )
    leaving = (
        grid.select(*BATCH, "n", F.inline(ends))
        .groupBy(*BATCH, "kind", "at")
        .agg(F.sum("n").alias("n"))
    )
    leaves_in = _first_batch_at(leaving.select("feed", "at").distinct(), clocks)
    gone = (
        leaving.join(leaves_in, ["feed", "at"])
        # An event that is stale on arrival never counts.
        .withColumn("batch_id", F.greatest("batch_id", "first_batch"))
        .groupBy(*BATCH)
        .agg(
            F.sum(F.when(F.col("kind") == "short", F.col("n"))).alias("short_gone"),
            F.sum(F.when(F.col("kind") == "base", F.col("n"))).alias("base_gone"),
        )
    )
    steps = stage(clocks.join(gone, BATCH, "left").fillna(0, ["short_gone", "base_gone"]))
    summed = running(
        steps,
        ["feed"],
        ["batch_id"],
        sums={
            "short_volume": F.col("arrived") - F.col("short_gone"),
            "baseline_total": F.col("arrived") - F.col("base_gone"),
        },
        span=span,
    )
    return summed.select(*BATCH, "clock", "arrived", "short_volume", "baseline_total")


def volumes_now(grid: DataFrame, arrived: DataFrame, p: Policy, initial: DataFrame | None = None) -> DataFrame:
    """`volumes` for one new batch per feed: one pass over what is still in view.

    At a single clock no expiry has to be placed, the two bounds suffice.
    """
    short, base = p.short_window_seconds * 1000, p.baseline_window_seconds * 1000
    clocks = running(arrived, ["feed"], ["batch_id"], maxes={"clock": F.col("newest")}, initial=initial, span=None)
    bucket_end = F.expr(f"(floor(occurred_at / {short}) + 1) * {short}")
    counted = (
        grid.join(clocks.select("feed", "clock"), "feed")
        .groupBy("feed")
        .agg(
            F.sum(F.when(bucket_end > F.col("clock") - short, F.col("n"))).alias("short_volume"),
            F.sum(F.when(F.col("occurred_at") >= F.col("clock") - base, F.col("n"))).alias("baseline_total"),
        )
    )
    return (
        clocks.join(counted, "feed", "left")
        .fillna(0, ["short_volume", "baseline_total"])
        .select(*BATCH, "clock", "arrived", "short_volume", "baseline_total")
    )


def _first_batch_at(instants: DataFrame, clocks: DataFrame) -> DataFrame:
    """For each (feed, at), the first batch with clock >= at; none if never.

    Clocks never go back, so that is the least batch among the later clocks.
    Instants and clocks meet per minute; only one row per minute meets per feed.
    """
    ticks = clocks.groupBy("feed", F.col("clock").alias("at")).agg(F.min("batch_id").alias("tick"))
    mixed = instants.unionByName(ticks.withColumn("is_tick", F.lit(True)), allowMissingColumns=True).withColumn(
        "slot", F.expr(f"at div {SLOT_MS}L")
    )
    # Frames are taken backwards: one that shrinks from the front is recomputed
    # for every row, one that grows is not.
    ahead = W.partitionBy("feed", "slot").orderBy(F.desc("at")).rangeBetween(W.unboundedPreceding, W.currentRow)
    near = mixed.withColumn("near", F.min("tick").over(ahead)).filter("is_tick IS NULL")
    slots = mixed.groupBy("feed", "slot").agg(F.min("tick").alias("first_tick"))
    later = W.partitionBy("feed").orderBy(F.desc("slot")).rowsBetween(W.unboundedPreceding, -1)
    beyond = slots.select("feed", "slot", F.min("first_tick").over(later).alias("next_tick"))
    return (
        near.join(beyond, ["feed", "slot"])
        .select("feed", "at", F.coalesce("near", "next_tick").alias("first_batch"))
        .filter("first_batch IS NOT NULL")
    )


def baseline_average(p: Policy) -> Column:
    return F.col("baseline_total") / F.lit(max(p.baseline_window_seconds / p.short_window_seconds, 1.0))


def stall_columns(counted: DataFrame, p: Policy) -> DataFrame:
    """Baseline average, drop and the stalled flag of each batch alone."""
    enough = F.col("short_volume") >= p.stall_min_volume
    if p.flag_outage:
        enough = F.lit(True)
    average = F.col("baseline_avg")
    drop = F.when(average > 0, F.lit(1.0) - F.col("short_volume") / average).otherwise(0.0)
    return (
        counted.withColumn("baseline_avg", baseline_average(p))
        .withColumn("drop_now", drop)
        .withColumn("stalled", enough & (F.col("drop_now") >= F.lit(p.stall_drop_ratio)))
    )


def stall_signal(
    counted: DataFrame, p: Policy, initial: DataFrame | None = None, span: int | None = SPAN
) -> DataFrame:
    """Stall streak and signal per batch.

    While a stall lasts the signal keeps the values of its first batch, only
    the streak moves. Below the minimum volume there is no stall. The input is
    read more than once: stage it.
    """
    judged = stall_columns(counted, p)
    ordered = streaks(
        judged,
        ["feed"],
        ["batch_id"],
        {"stall_streak": (F.col("stalled"), ~F.col("stalled"))},
        initial,
        span,
    )
    onset = F.struct("batch_id", "short_volume", "baseline_avg", "drop_now", "clock")
    begun = running(
        ordered,
        ["feed"],
        ["batch_id"],
        maxes={"stall_onset": F.when(F.col("stall_streak") == 1, onset)},
        initial=initial,
        span=span,
    )
    active = F.col("stalled")

    def held(name: str, otherwise: Column) -> Column:
        return F.when(active, F.col(f"stall_onset.{name}")).otherwise(otherwise)

    return begun.select(
        *BATCH,
        "clock",
        "short_volume",
        "baseline_total",
        "baseline_avg",
        "drop_now",
        active.alias("stall_active"),
        "stall_streak",
        held("short_volume", F.lit(0)).alias("stall_short_volume"),
        held("baseline_avg", F.lit(0.0)).alias("stall_baseline_avg"),
        held("drop_now", F.lit(0.0)).alias("stall_drop_ratio"),
        held("clock", F.lit(None).cast("bigint")).alias("stall_detected_at"),
        "stall_onset",
    )


def window_snapshot(counted: DataFrame, p: Policy) -> DataFrame:
    """Bounds and count of the short window at each batch."""
    return counted.select(
        *BATCH,
        (F.col("clock") - p.short_window_seconds * 1000).alias("window_start"),
        F.col("clock").alias("window_end"),
        F.col("short_volume").alias("record_count"),
    )


def volume_vs_baseline(df: DataFrame, p: Policy, span: int = 1440) -> DataFrame:
    """Each event-time window against the mean of the windows before it.

    Pure event time: windows of the short length that hold events, against the
    average over the baseline length that ends with them.
    """
    short, base = p.short_window_seconds, p.baseline_window_seconds
    per_window = tumbling(df, short).withColumn("__w", F.expr(f"bucket_start div {short * 1000}L"))
    reach = max(base // short, 1)
    seen = with_reach(per_window, "__w", span, reach)
    past = W.partitionBy("feed", "__chunk").orderBy("__w").rangeBetween(-reach, W.currentRow)
    averaged = seen.withColumn("baseline_avg", F.avg("events").over(past)).filter("__own")
    drop = F.lit(1.0) - F.col("events") / F.col("baseline_avg")
    return averaged.select(
        "feed",
        "bucket_start",
        "events",
        "baseline_avg",
        drop.alias("drop_ratio"),
        (drop >= F.lit(p.stall_drop_ratio)).alias("stalling"),
    )
