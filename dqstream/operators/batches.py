"""Micro-batches on tables and their quality report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqstream.contract import BATCH, INVALID_VALUE, MISSING_FIELD, SCHEMA_VIOLATION
from dqstream.policy import Policy


def assign_batches(df: DataFrame, size: int | None = None, span_ms: int | None = None) -> DataFrame:
    """Cut a table into batches by count or by receive time.

    By count, each source partition is a feed of its own and its offsets give
    the position, so no row has to be numbered. Ids are deterministic.
    """
    if (size is None) == (span_ms is None):
        raise ValueError("give either size or span_ms")
    if size is not None:
        feed = F.concat_ws("-", F.col("topic"), F.col("partition").cast("string"))
        return df.withColumn("feed", feed).withColumn("batch_id", F.expr(f"`offset` div {size}L"))
    return df.withColumn("batch_id", F.expr(f"received_at div {span_ms}L"))


def offset_context(df: DataFrame) -> DataFrame:
    """Topic and partition of a batch's first record, its first and last offset."""
    return df.groupBy(*BATCH).agg(
        F.min_by("topic", "seq").alias("topic"),
        F.min_by("partition", "seq").alias("partition"),
        F.min_by("offset", "seq").alias("offset_first"),
        F.max_by("offset", "seq").alias("offset_last"),
    )


def _occurrences(code: str) -> Column:
    codes = F.col("violations")
    return F.size(codes) - F.size(F.array_remove(codes, code))


def report_measures() -> list[Column]:
    """Aggregates over validated events, all taken in one pass."""
    return [
        F.count(F.lit(1)).alias("total_records"),
        F.count_if("is_valid").alias("passed"),
        F.sum(_occurrences(MISSING_FIELD)).alias("missing_required_fields"),
        F.sum(_occurrences(INVALID_VALUE)).alias("invalid_field_values"),
        F.count_if(F.array_contains("violations", SCHEMA_VIOLATION)).alias("schema_violations"),
    ]


def report_columns(sums: DataFrame, p: Policy) -> DataFrame:
    """Rates and flags from the aggregates."""
    fields = len(p.required_fields)
    null_rate = (
        F.col("missing_required_fields") / (F.col("total_records") * fields) if fields else F.lit(0.0)
    )
    rated = (
        sums.withColumn("quarantined", F.col("total_records") - F.col("passed"))
        .withColumn("null_rate", null_rate)
        .withColumn("schema_violation_rate", F.col("schema_violations") / F.col("total_records"))
    )
    return threshold_flags(rated, p)


def threshold_flags(report: DataFrame, p: Policy) -> DataFrame:
    """Warning and critical flags; critical implies warning, limits are inclusive."""

    def over(rate: str, limit: float) -> Column:
        return F.col(rate) >= F.lit(limit)

    return report.withColumns(
        {
            "null_rate_warning": over("null_rate", min(p.null_rate_warning, p.null_rate_critical)),
            "null_rate_critical": over("null_rate", p.null_rate_critical),
            "schema_rate_warning": over(
                "schema_violation_rate", min(p.schema_rate_warning, p.schema_rate_critical)
            ),
            "schema_rate_critical": over("schema_violation_rate", p.schema_rate_critical),
        }
    )


def batch_report(validated: DataFrame, p: Policy) -> DataFrame:
    """One row per batch: counts, rates and flags, from one grouping.

    Every measure is a sum or a count, so each task first folds its own rows
    and a hot batch reaches the shuffle as one row per task.
    """
    return report_columns(validated.groupBy(*BATCH).agg(*report_measures()), p)


def fill_empty(report: DataFrame, expected: DataFrame) -> DataFrame:
    """Give expected batches without events zero counts and no flags."""
    joined = expected.join(report, BATCH, "left")
    zero = {name: 0 for name, kind in report.dtypes if kind in ("bigint", "double") and name not in BATCH}
    off = {name: False for name, kind in report.dtypes if kind == "boolean"}
    return joined.fillna({**zero, **off})


def batch_latency(df: DataFrame) -> DataFrame:
    """Time from a batch's first to its last record, in milliseconds."""
    spans = df.groupBy(*BATCH).agg(
        F.min("received_at").alias("started_at"), F.max("received_at").alias("completed_at")
    )
    return spans.withColumn("latency_ms", latency(F.col("started_at"), F.col("completed_at")))


def latency(started: Column, completed: Column) -> Column:
    """Milliseconds between two epoch-ms instants, zero while open."""
    return F.coalesce((completed - started).cast("double"), F.lit(0.0))


def window_rate(df: DataFrame) -> DataFrame:
    """Records per second of a window; zero for a window without length."""
    seconds = (F.col("window_end") - F.col("window_start")) / 1000.0
    return df.withColumn(
        "volume_per_second", F.when(seconds > 0, F.col("record_count") / seconds).otherwise(0.0)
    )
