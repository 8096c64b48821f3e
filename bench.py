"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from dqstream.suite.queries import all_queries

HEADLINE = [
    "batch_quality_report",
    "validate_events",
    "breaker_with_reset",
    "route_clean",
    "dedup_window",
    "dedup_first_seen",
    "lag_p95_rolling",
    "lag_running",
    "short_window_volume",
    "stall_streak",
    "payload_key_drift",
    "alerts_fired",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # The first query pays for starting the session and its code paths.
    queries[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "events": events,
                "events_per_second": {n: round(events / s) for n, s in seconds.items()},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
