"""All signals of a batch in one row: report, lag, volume, score, outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqstream.contract import BATCH
from dqstream.operators.anomaly import anomaly
from dqstream.operators.batches import latency, report_columns, report_measures
from dqstream.operators.breaker import breaker
from dqstream.operators.lag import lag_measures, lag_p95, lag_running, lag_tails
from dqstream.operators.validate import validate_events
from dqstream.operators.volume import stall_signal, volume_grid, volumes, volumes_now
from dqstream.plans.scan import SPAN, span_of
from dqstream.plans.stage import stage
from dqstream.policy import Policy


def batch_facts(validated: DataFrame, p: Policy) -> DataFrame:
    """Report and lag aggregates of each batch from one grouping of the events."""
    sums = validated.groupBy(*BATCH).agg(
        *report_measures(),
        *lag_measures(p),
        F.min("received_at").alias("started_at"),
        F.max("received_at").alias("completed_at"),
    )
    return report_columns(sums, p).withColumn(
        "latency_ms", latency(F.col("started_at"), F.col("completed_at"))
    )


def combine(
    facts: DataFrame,
    tails: DataFrame,
    grid: DataFrame,
    p: Policy,
    resets: DataFrame | None = None,
    state: DataFrame | None = None,
    span: int | None = SPAN,
    one_batch: bool = False,
) -> DataFrame:
    """Run the batch-level operators over staged per-batch tables.

    `state` may hold the last row an earlier run gave per feed; `tails` and
    `grid` then also hold what of the earlier batches is still in view.
    Everything here works on one row per batch, but for the folded grid.
    `one_batch` says that no feed has more than one new batch.
    """
    # One window per step reads its input once; nothing has to be held then.
    held = stage if span is not None else (lambda df: df)
    arrived = facts.select(*BATCH, F.col("event_count").alias("arrived"), F.col("completed_at").alias("newest"))
    if one_batch:
        counted = volumes_now(grid, arrived, p, initial=state)
    elif state is None:
        counted = held(volumes(grid, p, arrived=arrived, span=span))
    else:
        counted = held(volumes(grid, p, initial=state, span=span).join(facts.select(*BATCH), BATCH, "left_semi"))
    stall = stall_signal(counted, p, initial=state, span=span)
    lag = lag_running(facts, initial=state, span=span)
    p95 = lag_p95(tails, p, span=span)
    # A batch without event times has no sample.
    joined = lag.join(p95, BATCH, "left").fillna(0, ["sample_count", "p95_lag_ms"]).join(stall, BATCH)
    return breaker(held(anomaly(joined, p)), p, resets, initial=state, span=span)


def signals(events: DataFrame, p: Policy, resets: DataFrame | None = None) -> DataFrame:
    """One staged row per batch with every signal.

    The events are read three times, each time for few columns: once with the
    payload for the report, twice for times only.
    """
    facts = stage(batch_facts(validate_events(events, p), p))
    tails = stage(lag_tails(events, p, counts=facts))
    grid = stage(volume_grid(events))
    return stage(combine(facts, tails, grid, p, resets, span=span_of(facts)))
