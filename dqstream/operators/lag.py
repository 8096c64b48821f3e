"""Event-time lag: lateness, running totals, rolling p95."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dqstream.contract import BATCH
from dqstream.plans.scan import SPAN, running, with_reach
from dqstream.plans.stage import stage
from dqstream.policy import Policy

# Sub-groups of a batch for the first of the two tail cuts.
TAIL_SPLITS = 32


def lag_column() -> Column:
    """Receive time minus event time, never below zero."""
    return F.greatest(F.col("received_at") - F.col("occurred_at"), F.lit(0))


def event_lag(df: DataFrame) -> DataFrame:
    return df.withColumn("lag_ms", lag_column())


def lag_measures(p: Policy) -> list[Column]:
    """Per-batch lag aggregates."""
    late = lag_column() > p.max_allowed_lag_ms
    return [
        F.count(lag_column()).alias("event_count"),
        F.count_if(late).alias("late_count"),
        F.max(lag_column()).alias("batch_max_lag_ms"),
    ]


def lag_batches(df: DataFrame, p: Policy) -> DataFrame:
    return df.groupBy(*BATCH).agg(*lag_measures(p))


def lag_running(
    batches: DataFrame, initial: DataFrame | None = None, span: int | None = SPAN
) -> DataFrame:
    """Totals since the start: events, late events, greatest lag, late ratios.

    A batch without event times shows zeros, the totals go on after it.
    """
    summed = running(
        batches,
        ["feed"],
        ["batch_id"],
        sums={"seen_events": F.col("event_count"), "seen_late": F.col("late_count")},
        maxes={"peak_lag_ms": F.col("batch_max_lag_ms")},
        initial=initial,
        span=span,
    )
    shown = {"total_event_count": "seen_events", "late_event_count": "seen_late", "max_seen_lag_ms": "peak_lag_ms"}
    any_events = F.col("event_count") > 0
    return (
        summed.withColumns({n: F.when(any_events, F.col(c)).otherwise(0) for n, c in shown.items()})
        .withColumn("late_ratio", ratio("late_event_count", "total_event_count"))
        .withColumn("batch_late_ratio", ratio("late_count", "event_count"))
    )


def ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def lag_tails(df: DataFrame, p: Policy, counts: DataFrame | None = None) -> DataFrame:
    """Per batch: its event count and the lags of its last samples, in order.

    `counts` may hold `event_count` per batch if it is known already.

    Only the last `lag_samples` events of a batch can be in a rolling sample.
    They are cut twice, first in hashed sub-groups, so that no task sorts a
    whole batch; each cut also runs per task ahead of its shuffle.
    """
    keep = p.lag_samples
    narrow = df.filter(lag_column().isNotNull()).select(
        *BATCH, "seq", lag_column().alias("lag_ms"), F.pmod(F.xxhash64("seq"), F.lit(TAIL_SPLITS)).alias("__sub")
    )
    sub = W.partitionBy(*BATCH, "__sub").orderBy(F.desc("seq"))
    whole = W.partitionBy(*BATCH).orderBy(F.desc("seq"))
    cut = narrow.withColumn("__rn", F.row_number().over(sub)).filter(F.col("__rn") <= keep)
    last = cut.withColumn("__rn", F.row_number().over(whole)).filter(F.col("__rn") <= keep)
    tails = last.groupBy(*BATCH).agg(
        F.sort_array(F.collect_list(F.struct("seq", "lag_ms"))).getField("lag_ms").alias("tail")
    )
    if counts is None:
        counts = narrow.groupBy(*BATCH).agg(F.count(F.lit(1)).alias("event_count"))
    return tails.join(counts.select(*BATCH, "event_count"), BATCH)


def lag_p95(tails: DataFrame, p: Policy, span: int | None = SPAN, fill: int = 16) -> DataFrame:
    """Rolling p95 over the last `lag_samples` lags up to each batch.

    The 0-based index is floor(0.95 n) of the sorted sample. A task takes
    `fill` samples' worth of events and looks one sample back. `tails` is read
    more than once: stage it.
    """
    keep = p.lag_samples
    ended = running(tails, ["feed"], ["batch_id"], sums={"__end": F.col("event_count")}, span=span)
    seen = with_reach(ended, "__end", fill * keep, keep)
    recent = W.partitionBy("feed", "__chunk").orderBy("__end").rangeBetween(-(keep - 1), W.currentRow)
    pooled = seen.withColumn("__lags", F.flatten(F.collect_list("tail").over(recent))).filter("__own")
    last = F.slice("__lags", -F.least(F.size("__lags"), F.lit(keep)), keep)
    ordered = pooled.withColumn("__sorted", F.sort_array(last))
    n = F.size("__sorted")
    index = (n * F.lit(0.95)).cast("int")
    return ordered.select(
        *BATCH,
        n.cast("bigint").alias("sample_count"),
        F.element_at("__sorted", index + 1).cast("double").alias("p95_lag_ms"),
    )


def split_late(df: DataFrame, p: Policy) -> tuple[DataFrame, DataFrame]:
    """On-time events, and late events kept apart with their event date."""
    lagged = event_lag(df)
    late = F.col("lag_ms") > p.max_allowed_lag_ms
    dated = lagged.withColumn("event_date", F.to_date(F.timestamp_millis("occurred_at")))
    return dated.filter(~late), dated.filter(late)


def late_corrections(df: DataFrame, p: Policy) -> DataFrame:
    """Per event date: on-time count and what the late events add to it."""
    late = F.col("lag_ms") > p.max_allowed_lag_ms
    return (
        event_lag(df)
        .withColumn("event_date", F.to_date(F.timestamp_millis("occurred_at")))
        .groupBy("feed", "event_date")
        .agg(
            F.count_if(~late).alias("on_time"),
            F.count_if(late).alias("late"),
            F.max(F.when(late, F.col("received_at"))).alias("last_correction_at"),
        )
    )
