"""Dedup, keys, routing, history."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from dqstream.operators import dedup as de
from dqstream.operators import history as hi
from dqstream.operators import intake as it
from dqstream.operators import routing as ro
from dqstream.plans.stage import stage, staging
from dqstream.policy import starter

SCHEMA = "k string, t bigint, o bigint"


def walk_guard(rows, seconds, seen=None):
    """Accepted rows: the key's last acceptance is more than the window ago."""
    last, out = dict(seen or {}), []
    for k, t, o in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last or t > last[k] + seconds * 1000:
            last[k] = t
            out.append(o)
    return sorted(out)


def key_rows(seed, n=400):
    rng = random.Random(seed)
    # A third of all rows have one key.
    return [("hot" if rng.random() < 0.34 else f"k{rng.randint(0, 60)}", rng.randint(0, 60) * 500, i) for i in range(n)]


@pytest.mark.parametrize("limit", [0, 5, 4096])
@pytest.mark.parametrize("seconds", [1, 3, 10])
def test_window_dedup(spark, limit, seconds):
    rows = key_rows(seconds)
    kept = de.dedup_window(spark.createDataFrame(rows, SCHEMA), "k", "t", "o", seconds, fold_limit=limit)
    assert sorted(r["o"] for r in kept.collect()) == walk_guard(rows, seconds)


def test_a_long_window_of_a_hot_key_is_cut_into_slots(spark):
    """A day's window over ten days: no slot of the key holds more than its minute."""
    rng = random.Random(5)
    rows = [("hot", rng.randint(0, 864_000) * 1000, i) for i in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = de.dedup_window(df, "k", "t", "o", 86_400, fold_limit=100)
    assert sorted(r["o"] for r in kept.collect()) == walk_guard(rows, 86_400)
    plan = de._next_instants(df.select("k", "t"), 86_400_000)._jdf.queryExecution().analyzed().toString()
    assert "60000" in plan


def test_window_edge_is_still_a_duplicate(spark):
    rows = [("a", 0, 1), ("a", 1000, 2), ("a", 1001, 3), ("a", 1500, 4), ("a", 2001, 5), ("a", 2002, 6), ("a", 0, 7)]
    kept = de.dedup_window(spark.createDataFrame(rows, SCHEMA), "k", "t", "o", 1)
    assert sorted(r["o"] for r in kept.collect()) == [1, 3, 6]


@pytest.mark.parametrize("limit", [0, 4096])
def test_window_dedup_goes_on_from_earlier_acceptances(spark, limit):
    rows = key_rows(9)
    first, second = [r for r in rows if r[1] < 12_000], [r for r in rows if r[1] >= 12_000]
    df1 = spark.createDataFrame(first, SCHEMA)
    kept1 = de.dedup_window(df1, "k", "t", "o", 3, fold_limit=limit)
    seen = kept1.groupBy("k").agg(F.max("t").alias("t"))
    kept2 = de.dedup_window(spark.createDataFrame(second, SCHEMA), "k", "t", "o", 3, seen, fold_limit=limit)
    got = sorted(r["o"] for r in kept1.unionByName(kept2).collect())
    assert got == walk_guard(rows, 3)


def test_first_seen(spark):
    rows = key_rows(4)
    got = de.first_seen(spark.createDataFrame(rows, SCHEMA), ["k"], ["t", "o"]).collect()
    want = {}
    for k, t, o in sorted(rows, key=lambda r: (r[1], r[2])):
        want.setdefault(k, o)
    assert {r["k"]: r["o"] for r in got} == want


ROW = (
    "feed string, batch_id bigint, event_id string, event_type string, event_version int, producer string, "
    "occurred_at bigint, partition_key string, payload_json string, trace_id string, headers map<string,string>, "
    "received_at bigint, violations array<string>, is_valid boolean"
)


def event(i, batch, violations=()):
    return ("f", batch, f"e{i}", "t", 1, "p", 5, "k", "{}", None, None, 9, list(violations), not violations)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def test_keys_follow_their_format(spark):
    bad = ["schema_violation", "invalid_field_value", "invalid_field_value"]
    df = spark.createDataFrame([event(1, 7, bad)], ROW)
    p = starter()
    assert ro.with_idempotency_key(df, p).first()["idempotency_key"] == digest("e1:clean_sink:")
    more = p.but(key_fields=("event_id", "trace_id", "producer"))
    assert ro.with_idempotency_key(df, more).first()["idempotency_key"] == digest("e1:clean_sink:None:p")
    want = digest("e1:7:dlq:invalid_field_value.invalid_field_value.schema_violation")
    assert ro.with_dlq_key(df).first()["idempotency_key"] == want


def test_shadow_share(spark):
    df = ro.with_idempotency_key(spark.createDataFrame([event(i, 1) for i in range(300)], ROW), starter())
    for share in (0.0, 0.07, 0.29, 1.0):
        got = {r["event_id"] for r in ro.shadow_sample(df, starter(shadow_percentage=share)).collect()}
        want = {f"e{i}" for i in range(300) if share > 0 and (int(digest(f"e{i}:clean_sink:")[:8], 16) % 100) / 100.0 < share}
        assert got == want


def test_routes_per_event(spark):
    df = spark.createDataFrame(
        [event(1, 1), event(2, 2), event(3, 2, ["invalid_field_value"]), event(4, 3), event(5, 3, ["x"])], ROW
    )
    outcomes = spark.createDataFrame([("f", 1, "pass"), ("f", 2, "quarantine"), ("f", 3, "halt")], "feed string, batch_id bigint, outcome string")
    routes = ro.route(df, outcomes, starter())
    assert [sorted(r["event_id"] for r in x.collect()) for x in routes] == [["e1", "e2"], ["e3"], ["e4", "e5"]]
    assert [x.count() for x in ro.route(df, outcomes, starter(mode="dry_run"))] == [0, 0, 0]
    assert [x.count() for x in ro.route(df, outcomes, starter(mode="shadow"))] == [2, 1, 2]


def test_dead_letter_row(spark):
    df = ro.with_dlq_key(spark.createDataFrame([event(3, 2, ["b", "a"])], ROW))
    row = ro.dlq_sink_rows(df, "bad").first()
    assert (row["topic"], row["key"], row["headers"][0]["key"]) == ("bad", "k", "idempotency_key")
    body = json.loads(row["value"])
    assert body == {
        "event_id": "e3", "event_type": "t", "reason_codes": ["b", "a"], "quarantined_at": 9, "batch_id": 2,
        "error_detail": "", "original_payload_json": "{}",
    }
    own = df.withColumn("record_trace_id", F.lit("own")).withColumn("error_detail", F.lit("why"))
    letter = ro.dlq_records(own).first()
    assert (letter["trace_id"], letter["error_detail"]) == ("own", "why")
    counts = {r["reason_code"]: r["records"] for r in ro.dlq_reason_counts(df).collect()}
    assert counts == {"a": 1, "b": 1}


HISTORY = (
    "feed string, batch_id bigint, outcome string, total_records bigint, null_rate double, p95_lag_ms double, "
    "anomaly_score double, passed bigint, started_at timestamp, completed_at timestamp, started_date date"
)


def history(spark, ids, outcome="pass"):
    rows = spark.createDataFrame([(i,) for i in ids], "i bigint")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("i") * 3600)
    return rows.select(
        F.lit("f").alias("feed"), F.col("i").alias("batch_id"), F.lit(outcome).alias("outcome"), F.lit(10).cast("bigint").alias("total_records"),
        (F.col("i") / 100).alias("null_rate"), F.lit(1.0).alias("p95_lag_ms"), F.lit(0.5).alias("anomaly_score"),
        F.lit(9).cast("bigint").alias("passed"), at.alias("started_at"), at.alias("completed_at"), F.to_date(at).alias("started_date"),
    )


def test_append_ignores_stored_batches(spark, tmp_path):
    path = str(tmp_path / "history")
    hi.append_new(history(spark, [1, 2, 2, 3]), path)
    hi.append_new(history(spark, [3, 4], "halt"), path)
    hi.append_new(history(spark, [3, 4], "halt"), path)
    stored = hi.read_history(spark, path)
    assert sorted((r["batch_id"], r["outcome"]) for r in stored.collect()) == [(1, "pass"), (2, "pass"), (3, "pass"), (4, "halt")]
    assert hi.by_outcome(stored, "halt", "2024-01-01").count() == 1
    assert hi.by_outcome(stored, "halt", "2024-01-02").count() == 0


def test_recent_stats(spark):
    rows = history(spark, range(10))
    at_nine = (1_704_067_200 + 9 * 3600) * 1000
    for r in (hi.recent_stats(rows, at_nine, 120).first(), hi.recent_stats(rows, minutes=120).first()):
        assert (r["total_batches"], r["total_records"], r["avg_null_rate"]) == (3, 30, 0.08)
    empty = hi.recent_stats(rows, at_nine + 10**9, 1).first()
    assert tuple(empty) == (0, 0, 0.0, 0.0, 0.0)


def test_weekdays_count_from_sunday(spark):
    # 2024-01-01 is a Monday.
    got = hi.quality_by_weekday(history(spark, [0])).collect()
    assert {(r["weekday"], r["hour"]): r["quality"] for r in got} == {(2, 0): 0.9, (2, None): 0.9, (None, None): 0.9}


def test_consumer_lag_and_backpressure(spark):
    high = spark.createDataFrame([("t", 0, 100), ("t", 1, 50), ("t", 2, 5)], "topic string, partition int, high bigint")
    done = spark.createDataFrame([("t", 0, 90), ("t", 1, 60)], "topic string, partition int, committed bigint")
    lag = it.consumer_lag(done, high)
    assert lag.first()["consumer_lag"] == 15
    assert not it.backpressure_flag(lag, starter(throttle_on_lag=15)).first()["backpressure"]
    assert it.backpressure_flag(lag, starter(throttle_on_lag=14)).first()["backpressure"]
    assert not it.backpressure_flag(lag, starter(throttle_on_lag=0)).first()["backpressure"]
    assert it.reading_limit(starter()) is None
    assert it.reading_limit(starter(rate_limit_records_per_sec=200, batch_timeout_ms=500)) == 100


def test_staged_tables_go_with_their_scope(spark):
    with staging(spark):
        kept = stage(spark.range(3))
        assert kept.count() == 3
        path = kept.inputFiles()[0].rsplit("/", 1)[0]
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def test_recent_stats_open_the_needed_dates_only(spark, tmp_path):
    start = F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("id") * 600_000)
    rows = spark.range(1_000).select(
        start.alias("started_at"),
        start.alias("completed_at"),
        F.lit(10).cast("bigint").alias("total_records"),
        *[F.lit(0.5).alias(c) for c in ("null_rate", "p95_lag_ms", "anomaly_score")],
        F.to_date(start).alias("started_date"),
    )
    rows.write.partitionBy("started_date").parquet(str(tmp_path / "h"))
    stats = hi.recent_stats(spark.read.parquet(str(tmp_path / "h")))
    assert stats.first()["total_batches"] == 7
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert any("started_date" in p.split("]")[0] for p in plan.split("PartitionFilters: [")[1:])
