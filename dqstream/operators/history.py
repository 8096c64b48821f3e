"""Quality history: one row per batch, and queries over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqstream.contract import BATCH
from dqstream.operators.dedup import first_seen


def history_rows(signals: DataFrame) -> DataFrame:
    """The stored row of a batch, rates rounded, partitioned by start date."""
    start = F.timestamp_millis("started_at")
    return signals.select(
        *BATCH,
        "outcome",
        "total_records",
        "passed",
        "quarantined",
        "schema_violations",
        "missing_required_fields",
        "invalid_field_values",
        F.round("null_rate", 6).alias("null_rate"),
        F.round("schema_violation_rate", 6).alias("schema_violation_rate"),
        F.round("p95_lag_ms", 2).alias("p95_lag_ms"),
        F.round("late_ratio", 6).alias("late_ratio"),
        "stall_active",
        F.round("anomaly_score", 4).alias("anomaly_score"),
        F.round("latency_ms", 2).alias("latency_ms"),
        start.alias("started_at"),
        F.timestamp_millis(F.coalesce("completed_at", "started_at")).alias("completed_at"),
        F.to_date(start).alias("started_date"),
    )


def new_rows(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose batch is not stored yet, each batch once.

    The first of equal batches by start time is kept. A stored batch stays as it
    is whatever start date it comes with, so the ids of all dates are compared;
    only those two columns are read.
    """
    once = first_seen(rows, BATCH, ["started_at", "completed_at"])
    return once.join(stored.select(*BATCH), BATCH, "left_anti")


def append_new(rows: DataFrame, path: str) -> None:
    """Append to a history table; batches already there stay as they are."""
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    fresh = new_rows(rows, read_history(spark, path, rows.schema)) if exists else first_seen(
        rows, BATCH, ["started_at", "completed_at"]
    )
    fresh.write.mode("append").partitionBy("started_date").parquet(path)


def read_history(spark, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def recent_stats(history: DataFrame, now_ms: int | None = None, minutes: int = 60) -> DataFrame:
    """Counts and means of the batches started in the last minutes.

    `now_ms` defaults to the newest completion in the table, a scalar subquery.
    """
    if now_ms is None:
        # The newest completion reads one column; its date then prunes the folders of the rest.
        bound = history.agg((F.max("completed_at") - F.expr(f"INTERVAL '{minutes}' MINUTE")).alias("bound")).scalar()
    else:
        bound = F.timestamp_millis(F.lit(now_ms - minutes * 60_000))
    recent = history.filter((F.col("started_at") >= bound) & (F.col("started_date") >= F.to_date(bound)))
    return recent.agg(
        F.count(F.lit(1)).alias("total_batches"),
        F.coalesce(F.sum("total_records"), F.lit(0)).alias("total_records"),
        F.coalesce(F.round(F.avg("null_rate"), 4), F.lit(0.0)).alias("avg_null_rate"),
        F.coalesce(F.round(F.avg("p95_lag_ms"), 2), F.lit(0.0)).alias("avg_p95_lag_ms"),
        F.coalesce(F.round(F.avg("anomaly_score"), 4), F.lit(0.0)).alias("avg_anomaly_score"),
    )


def by_outcome(history: DataFrame, outcome: str, since: str | None = None) -> DataFrame:
    """Batches of one outcome, newest dates pruned by partition."""
    found = history.filter(F.col("outcome") == outcome)
    if since is not None:
        found = found.filter(F.col("started_date") >= F.lit(since).cast("date"))
    return found


def quality_by_weekday(history: DataFrame) -> DataFrame:
    """Share of passed records per weekday and hour, per weekday, and overall.

    Weekdays count from Sunday = 1; subtotals have nulls.
    """
    return (
        history.withColumn("weekday", F.dayofweek("started_at"))
        .withColumn("hour", F.hour("started_at"))
        .rollup("weekday", "hour")
        .agg(
            F.count(F.lit(1)).alias("batches"),
            F.sum("total_records").alias("records"),
            (F.sum("passed") / F.sum("total_records")).alias("quality"),
        )
    )
