"""Consumer lag and backpressure from offset tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqstream.policy import Policy


def partition_lag(committed: DataFrame, high: DataFrame) -> DataFrame:
    """Records behind per partition; no commit reads as zero."""
    return high.join(committed, ["topic", "partition"], "left").select(
        "topic",
        "partition",
        F.greatest(F.col("high") - F.coalesce("committed", F.lit(0)), F.lit(0)).alias("lag"),
    )


def consumer_lag(committed: DataFrame, high: DataFrame) -> DataFrame:
    return partition_lag(committed, high).groupBy("topic").agg(F.sum("lag").alias("consumer_lag"))


def backpressure_flag(lag: DataFrame, p: Policy) -> DataFrame:
    """True while a feed is further behind than the policy allows; 0 is off."""
    limit = p.throttle_on_lag
    over = F.col("consumer_lag") > limit if limit > 0 else F.lit(False)
    return lag.withColumn("backpressure", over)


def reading_limit(p: Policy) -> int | None:
    """Records per trigger that hold the policy's rate limit; None is no limit."""
    if p.rate_limit_records_per_sec <= 0:
        return None
    return max(1, int(p.rate_limit_records_per_sec * p.batch_timeout_ms / 1000))
