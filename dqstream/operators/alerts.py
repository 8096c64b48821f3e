"""Streak-based alerts over batch rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqstream.contract import BATCH, HALT
from dqstream.operators.breaker import ORDER, with_resets
from dqstream.plans.scan import SPAN, running, streaks
from dqstream.plans.stage import stage
from dqstream.policy import Policy

# Alert levels.
WARNING = "warning"
CRITICAL = "critical"

# Alert rules in the order they are reported.
RULES = ["stall", "null_rate", "schema", "lag", "anomaly", "halt"]

# Fixed value: from this streak on a stall points to the long-stall runbook.
LONG_STALL = 3

# What to do, by runbook key. The keys are fixed values; a deployment may bring
# its own texts as a table.
RUNBOOKS = {
    "null_rate_warning": "Required fields are going missing. Look for renamed or dropped fields upstream.",
    "null_rate_critical": "Many required fields are missing. Page the owner of the producing service.",
    "schema_violation_critical": "Envelopes break the contract. Roll the producer back or fix its schema.",
    "stall_detected": "Volume fell under its baseline. See whether the producers and brokers are healthy.",
    "consecutive_stall": "The volume drop lasts. Treat it as an outage of a producer or of the transport.",
    "high_lag": "Events arrive late. Expect corrections downstream and look for clients that were offline.",
    "anomaly_detected": "Several signals moved together. Compare with recent releases before acting.",
    "circuit_breaker_halted": "The gate is closed. Mend the cause, then add a manual reset to open it.",
}


def runbook_table(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    rows = list((RUNBOOKS if texts is None else texts).items())
    return spark.createDataFrame(rows, "runbook_key string, runbook string")


def alert_streaks(
    signals: DataFrame,
    p: Policy,
    resets: DataFrame | None = None,
    initial: DataFrame | None = None,
    span: int | None = SPAN,
) -> DataFrame:
    """Add a streak per rule. A reset clears all but the stall streak.

    The stall streak belongs to the volume monitor, which a reset leaves alone.
    A batch without events so far holds the lag streak.
    """
    placed = with_resets(signals, resets)
    batch = F.col("__is_batch") == 1
    any_events = F.col("total_event_count") > 0
    too_late = F.col("late_ratio") > F.lit(float(p.late_ratio_critical))

    def rule(on: Column, off: Column) -> tuple[Column, Column]:
        return batch & on, ~batch | off

    return streaks(
        placed,
        ["feed"],
        ORDER,
        {
            "null_rate_streak": rule(F.col("null_rate_critical"), ~F.col("null_rate_critical")),
            "schema_streak": rule(F.col("schema_rate_critical"), ~F.col("schema_rate_critical")),
            "lag_streak": rule(any_events & too_late, any_events & ~too_late),
            "anomaly_streak": rule(F.col("anomaly_active"), ~F.col("anomaly_active")),
        },
        initial,
        span,
    )


def halt_alerts(
    outcomes: DataFrame,
    resets: DataFrame | None = None,
    initial: DataFrame | None = None,
    span: int | None = SPAN,
) -> DataFrame:
    """Add `halt_alert`: the first halted batch since the last reset."""
    placed = outcomes if "__is_batch" in outcomes.columns else with_resets(outcomes, resets)
    batch = F.col("__is_batch") == 1
    here = F.struct(*[F.col(c) for c in ORDER])
    halted = batch & (F.col("outcome") == HALT)
    seen = running(
        placed,
        ["feed"],
        ORDER,
        maxes={"last_alert_reset": F.when(~batch, here)},
        maxes_before={"last_halt": F.when(halted, here)},
        initial=initial,
        span=span,
    )
    already = F.coalesce(
        F.col("last_halt").isNotNull()
        & (F.col("last_alert_reset").isNull() | (F.col("last_halt") > F.col("last_alert_reset"))),
        F.lit(False),
    )
    return (
        seen.withColumn("halt_alert", F.coalesce(halted, F.lit(False)) & ~already)
        .withColumn("last_halt", F.when(halted, here).otherwise(F.col("last_halt")))
        .filter(batch)
        .drop("__is_batch")
    )


def _fired(p: Policy) -> Column:
    """One struct per rule; the level is null where the rule is quiet."""
    w = p.warning_windows
    whole = int(w * p.critical_multiplier)

    def entry(rule: str, streak: str, level: Column, key: Column) -> Column:
        return F.struct(
            F.lit(RULES.index(rule)).alias("ordinal"),
            F.lit(rule).alias("rule"),
            level.alias("level"),
            F.col(streak).alias("streak"),
            key.alias("runbook_key"),
        )

    def graded(streak: str, limit: float) -> Column:
        return F.when(F.col(streak) >= F.lit(limit), CRITICAL).when(F.col(streak) >= w, WARNING)

    def only(streak: str, level: str) -> Column:
        return F.when(F.col(streak) >= w, level)

    # A multiplier under one cannot fire ahead of the warning streak.
    stall = F.when(F.col("stall_streak") >= w, graded("stall_streak", w * p.critical_multiplier))
    nulls = F.when(F.col("null_rate_streak") >= w, graded("null_rate_streak", whole))
    return F.array(
        entry(
            "stall",
            "stall_streak",
            stall,
            F.when(F.col("stall_streak") >= LONG_STALL, "consecutive_stall").otherwise("stall_detected"),
        ),
        entry(
            "null_rate",
            "null_rate_streak",
            nulls,
            F.when(nulls == CRITICAL, "null_rate_critical").otherwise("null_rate_warning"),
        ),
        entry("schema", "schema_streak", only("schema_streak", CRITICAL), F.lit("schema_violation_critical")),
        entry("lag", "lag_streak", only("lag_streak", WARNING), F.lit("high_lag")),
        entry("anomaly", "anomaly_streak", only("anomaly_streak", WARNING), F.lit("anomaly_detected")),
    )


def fired(counted: DataFrame, p: Policy) -> DataFrame:
    """Alert rows of batches with streaks."""
    return counted.select(*BATCH, F.inline(_fired(p))).filter(F.col("level").isNotNull())


def fired_halts(marked: DataFrame) -> DataFrame:
    """Alert rows of batches with `halt_alert`."""
    return marked.filter("halt_alert").select(
        *BATCH,
        F.lit(RULES.index("halt")).alias("ordinal"),
        F.lit("halt").alias("rule"),
        F.lit(CRITICAL).alias("level"),
        F.lit(1).cast("bigint").alias("streak"),
        F.lit("circuit_breaker_halted").alias("runbook_key"),
    )


def alerts(
    signals: DataFrame,
    p: Policy,
    resets: DataFrame | None = None,
    initial: DataFrame | None = None,
    span: int | None = SPAN,
) -> DataFrame:
    """One row per fired alert: rule, level, streak and runbook key."""
    return fired(alert_streaks(signals, p, resets, initial, span).filter("__is_batch = 1"), p)


def halt_alert_rows(
    outcomes: DataFrame,
    resets: DataFrame | None = None,
    initial: DataFrame | None = None,
    span: int | None = SPAN,
) -> DataFrame:
    """The halt alert as alert rows."""
    return fired_halts(halt_alerts(outcomes, resets, initial, span))


def all_alerts(
    signals: DataFrame,
    p: Policy,
    resets: DataFrame | None = None,
    initial: DataFrame | None = None,
    span: int | None = SPAN,
) -> DataFrame:
    """Alerts of all rules and of halts, from one chain over the batches."""
    judged = stage(halt_alerts(alert_streaks(signals, p, resets, initial, span), initial=initial, span=span))
    return fired(judged, p).unionByName(fired_halts(judged))


def fired_levels(fired: DataFrame) -> DataFrame:
    """Levels per batch in rule order."""
    ordered = F.sort_array(F.collect_list(F.struct("ordinal", "rule", "level")))
    return fired.groupBy(*BATCH).agg(
        F.transform(ordered, lambda x: F.concat_ws("=", x["rule"], x["level"])).alias("levels")
    )


def with_runbook(fired: DataFrame, runbooks: DataFrame) -> DataFrame:
    """Add the runbook text; a key without one gets a note saying so."""
    return fired.join(runbooks, "runbook_key", "left").withColumn(
        "runbook", F.coalesce("runbook", F.concat(F.col("runbook_key"), F.lit(": no steps are on file")))
    )
