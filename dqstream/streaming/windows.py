"""Event-time volumes on the stream, finished by the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqstream.policy import Policy


def volume_vs_baseline_stream(events: DataFrame, p: Policy, delay_seconds: int) -> DataFrame:
    """`volume_vs_baseline` as an append stream: a row per window once the watermark has passed it.

    Events are counted per short window; those counts, not the events, enter the
    sliding windows of baseline length that end with a short window. Events more
    than `delay_seconds` behind the newest are left out and counted by the engine.
    """
    short = p.short_window_seconds
    reach = max(p.baseline_window_seconds // short, 1)
    timed = events.where("occurred_at IS NOT NULL").select("feed", F.timestamp_millis("occurred_at").alias("ts"))
    counted = (
        timed.withWatermark("ts", f"{delay_seconds} seconds")
        .groupBy("feed", F.window("ts", f"{short} seconds"))
        .agg(F.count(F.lit(1)).alias("events"))
    )
    sliding = F.window(F.window_time("window"), f"{(reach + 1) * short} seconds", f"{short} seconds")
    averaged = counted.groupBy("feed", sliding.alias("frame")).agg(
        F.avg("events").alias("baseline_avg"), F.max(F.struct("window.end", "events")).alias("own")
    )
    drop = F.lit(1.0) - F.col("events") / F.col("baseline_avg")
    # Frames that end where the feed has no events belong to no window.
    return (
        averaged.where("own.end = frame.end")
        .select("feed", (F.unix_millis("own.end") - short * 1000).alias("bucket_start"), "own.events", "baseline_avg")
        .select("*", drop.alias("drop_ratio"), (drop >= F.lit(p.stall_drop_ratio)).alias("stalling"))
    )
