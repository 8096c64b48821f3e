"""Weighted anomaly score of a batch from volume, lag and violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqstream.policy import Policy


def components(signals: DataFrame, p: Policy) -> DataFrame:
    """Add the three component scores, each between 0 and 1."""
    ratio = F.lit(float(p.stall_drop_ratio))
    drop = F.col("stall_drop_ratio")
    volume = F.when(
        F.col("stall_active") & (drop >= ratio), F.least(drop / ratio, F.lit(1.0))
    ).otherwise(0.0)

    allowed = F.lit(float(p.max_allowed_lag_ms))
    worst = F.col("max_seen_lag_ms").cast("double")
    lag = (
        F.when(F.col("total_event_count") == 0, 0.0)
        .when(worst >= allowed, F.least(F.col("late_ratio") * F.lit(5.0), F.lit(1.0)))
        .otherwise(F.least(worst / allowed * F.lit(0.5), F.lit(0.5)))
    )

    raised = (
        (F.col("quarantined") > 0).cast("int")
        + F.col("null_rate_critical").cast("int")
        + F.col("schema_rate_critical").cast("int")
    )
    violation = F.when(F.col("total_records") == 0, 0.0).otherwise(raised / F.lit(3.0))
    return signals.withColumns({"volume_score": volume, "lag_score": lag, "violation_score": violation})


def details(p: Policy) -> Column:
    """Names the components that reach the threshold of the total."""
    limit = F.lit(float(p.score_threshold))
    none = F.array().cast("array<string>")
    parts: list[Column] = []
    for name in ("volume", "lag", "violation"):
        score = F.col(f"{name}_score")
        text = F.format_string(f"{name}_anomaly(score=%.2f)", score)
        parts.append(F.when(score >= limit, F.array(text)).otherwise(none))
    return F.concat(none, *parts)


def anomaly(signals: DataFrame, p: Policy) -> DataFrame:
    """Add component scores, contributions, total, active flag and details."""
    scored = components(signals, p)
    total = (
        F.lit(p.volume_weight) * F.col("volume_score")
        + F.lit(p.lag_weight) * F.col("lag_score")
        + F.lit(p.violation_weight) * F.col("violation_score")
    )
    return (
        scored.withColumn("anomaly_score", total)
        .withColumn("anomaly_active", F.col("anomaly_score") >= F.lit(float(p.score_threshold)))
        .withColumns(
            {
                "volume_contribution": F.lit(p.volume_weight) * F.col("volume_score"),
                "lag_contribution": F.lit(p.lag_weight) * F.col("lag_score"),
                "violation_contribution": F.lit(p.violation_weight) * F.col("violation_score"),
                "anomaly_detected_at": F.when(F.col("anomaly_active"), F.col("clock")),
                "anomaly_details": details(p),
            }
        )
    )
