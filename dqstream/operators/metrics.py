"""Counters, histograms, gauges and dashboard series over batch rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqstream.contract import BATCH, HALT
from dqstream.functions import keys
from dqstream.operators.intake import backpressure_flag
from dqstream.policy import Policy

# Upper bucket edges.
DURATION_SECONDS_EDGES = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
VALIDATION_MS_EDGES = [10.0, 25.0, 50.0, 100.0, 200.0, 500.0, 1000.0, 2500.0]
EVENT_LAG_MS_EDGES = [100.0, 500.0, 1000.0, 5000.0, 10000.0, 30000.0, 60000.0, 120000.0]


def _pairs(label: str, value: str, entries: dict[str, Column]) -> Column:
    """One row per entry from columns of one row."""
    return F.inline(F.array(*[F.struct(F.lit(k).alias(label), c.alias(value)) for k, c in entries.items()]))


def counters(h: DataFrame) -> DataFrame:
    """Records by outcome; halts count batches."""
    summed = h.groupBy("feed").agg(
        F.sum("passed").alias("__p"), F.sum("quarantined").alias("__q"), F.count_if(F.col("outcome") == HALT).alias("__h")
    )
    return summed.select(
        "feed",
        _pairs("outcome", "total", {"pass": F.col("__p"), "quarantine": F.col("__q"), "halt": F.col("__h")}),
    )


def histogram(h: DataFrame, value: Column, edges: Sequence[float], metric: str) -> DataFrame:
    """Cumulative bucket counts; the last bucket holds all."""
    measured = h.groupBy("feed").agg(
        *[F.count_if(value <= F.lit(e)).alias(f"__{i}") for i, e in enumerate(edges)],
        F.count(value).alias("__all"),
    )
    buckets = {f"{e:g}": F.col(f"__{i}") for i, e in enumerate(edges)}
    return measured.select(
        "feed", F.lit(metric).alias("metric"), _pairs("le", "observations", {**buckets, "+Inf": F.col("__all")})
    )


def histograms(h: DataFrame) -> DataFrame:
    """Batch duration, validation latency and greatest event lag."""
    return (
        histogram(h, F.col("latency_ms") / F.lit(1000.0), DURATION_SECONDS_EDGES, "batch_duration_seconds")
        .unionByName(histogram(h, F.col("latency_ms"), VALIDATION_MS_EDGES, "validation_latency_ms"))
        .unionByName(
            histogram(h, F.col("max_seen_lag_ms").cast("double"), EVENT_LAG_MS_EDGES, "event_lag_ms")
        )
    )


def _gauges(p: Policy) -> dict[str, Column]:
    return {
        "null_rate": F.col("null_rate"),
        "schema_violation_rate": F.col("schema_violation_rate"),
        "circuit_breaker_state": (F.col("outcome") == HALT).cast("double"),
        "late_event_ratio": F.col("late_ratio"),
        "p95_lag_ms": F.col("p95_lag_ms"),
        "short_window_volume": F.col("stall_short_volume").cast("double"),
        "baseline_volume_avg": F.col("stall_baseline_avg"),
        "stall_active": F.col("stall_active").cast("double"),
        "consecutive_stall_windows": F.when(F.col("stall_active"), F.col("stall_streak")).otherwise(0).cast("double"),
        "anomaly_score": F.col("anomaly_score"),
        "anomaly_active": F.col("anomaly_active").cast("double"),
        # 0 dry run, 1 shadow, 2 enforcement
        "rollout_mode": F.lit(float(("dry_run", "shadow", "enforcement").index(p.mode))),
    }


def latest_gauges(h: DataFrame, p: Policy) -> DataFrame:
    """The value each gauge shows after the last batch of a feed."""
    made = _gauges(p)
    last = h.groupBy("feed").agg(
        F.max_by(F.struct(*[c.alias(n) for n, c in made.items()]), "batch_id").alias("__g")
    )
    return last.select("feed", _pairs("gauge", "value", {n: F.col(f"__g.{n}") for n in made}))


def rollout_counts(keyed_clean: DataFrame, lag: DataFrame, p: Policy) -> DataFrame:
    """Clean records per feed, those of the shadow copy, and backpressure per topic."""
    picked = F.lit(False)
    if p.shadow_percentage > 0:
        picked = keys.hash_share(F.col("idempotency_key")) < F.lit(float(p.shadow_percentage))
    counted = keyed_clean.groupBy("feed").agg(
        F.count(F.lit(1)).alias("__clean"), F.count_if(picked).alias("__shadow")
    )
    copies = counted.select(
        F.col("feed").alias("source"),
        _pairs("metric", "value", {"clean_records": F.col("__clean"), "shadow_routed": F.col("__shadow")}),
    )
    pressure = backpressure_flag(lag, p).select(
        F.col("topic").alias("source"),
        F.lit("backpressure_active").alias("metric"),
        F.col("backpressure").cast("bigint").alias("value"),
    )
    return copies.unionByName(pressure)


def records_rate(h: DataFrame) -> DataFrame:
    """Records per second by outcome and minute of completion."""
    minute = F.date_trunc("minute", F.timestamp_millis("completed_at"))
    summed = h.groupBy("feed", F.unix_millis(minute).alias("minute_ms")).agg(
        F.sum("passed").alias("__p"), F.sum("quarantined").alias("__q"), F.count_if(F.col("outcome") == HALT).alias("__h")
    )
    rates = {
        name: F.col(c) / F.lit(60.0) for name, c in (("pass", "__p"), ("quarantine", "__q"), ("halt", "__h"))
    }
    return summed.select("feed", "minute_ms", _pairs("outcome", "per_second", rates))


def threshold_series(h: DataFrame, p: Policy) -> DataFrame:
    """Panels with limits: null rate, score, stall and anomaly, with severity."""

    def graded(value: Column, warning: float, critical: float) -> Column:
        return F.when(value >= F.lit(critical), "critical").when(value >= F.lit(warning), "warning").otherwise("ok")

    stall, active = F.col("stall_active").cast("double"), F.col("anomaly_active").cast("double")
    limits = {
        "null_rate": (F.col("null_rate"), p.null_rate_warning, p.null_rate_critical),
        "anomaly_score": (F.col("anomaly_score"), p.score_threshold, p.score_threshold),
        "stall_active": (stall, 1.0, 1.0),
        "anomaly_active": (active, 1.0, 1.0),
    }
    rows = [
        F.struct(F.lit(n).alias("series"), v.alias("value"), graded(v, w, c).alias("severity"))
        for n, (v, w, c) in limits.items()
    ]
    return h.select(*BATCH, F.inline(F.array(*rows)))


def quality_series(h: DataFrame) -> DataFrame:
    """Panels without limits: latency, p95 lag, rates, volume and baseline."""
    return h.select(
        *BATCH,
        _pairs(
            "series",
            "value",
            {
                "latency_ms": F.col("latency_ms"),
                "p95_lag_ms": F.col("p95_lag_ms"),
                "schema_violation_rate": F.col("schema_violation_rate"),
                "late_event_ratio": F.col("late_ratio"),
                "short_window_volume": F.col("short_volume").cast("double"),
                "baseline_volume_avg": F.col("baseline_avg"),
            },
        ),
    )


def latency_bucket_rates(h: DataFrame) -> DataFrame:
    """Batches per second in each duration bucket, by minute of completion."""
    minute = F.unix_millis(F.date_trunc("minute", F.timestamp_millis("completed_at")))
    seconds = F.col("latency_ms") / F.lit(1000.0)
    counted = h.groupBy("feed", minute.alias("minute_ms")).agg(
        *[F.count_if(seconds <= F.lit(e)).alias(f"__{i}") for i, e in enumerate(DURATION_SECONDS_EDGES)]
    )
    rates = {f"{e:g}": F.col(f"__{i}") / F.lit(60.0) for i, e in enumerate(DURATION_SECONDS_EDGES)}
    return counted.select("feed", "minute_ms", _pairs("le", "per_second", rates))
