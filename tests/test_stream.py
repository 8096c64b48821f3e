"""The gate as a stream: parity with tables, restart, halt and reset, replay."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from dqstream.operators import alerts as al
from dqstream.operators import history as hi
from dqstream.operators import metrics as me
from dqstream.operators.dedup import dedup_stream
from dqstream.operators.signals import signals
from dqstream.plans.stage import stage
from dqstream.sources import fixtures as fx
from dqstream.sources.readers import EVENTS, from_transport, read_folder
from dqstream.streaming.gate import Gate, run_stream
from dqstream.suite.queries import DAYS

# Half of the records of a structural run may be broken: no batch halts.
CALM = DAYS.but(schema_rate_critical=0.9)


def land(df, folder):
    """One more file, with a later modification time than the last."""
    df.coalesce(1).write.mode("append").parquet(folder)
    time.sleep(1.1)


def rows_of(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_stream_with_restart_equals_the_table(spark, sf_dir, tmp_path):
    root, folder = str(tmp_path / "out"), str(tmp_path / "in")
    events = fx.time_batches(spark, sf_dir).select(*EVENTS.fieldNames()).persist()
    low, high = events.agg(F.min("batch_id"), F.max("batch_id")).first()
    edges = [low, low + 35, low + 70, high + 1]
    parts = [events.filter(F.col("batch_id").between(a, b - 1)) for a, b in zip(edges, edges[1:])]

    def run():
        stream = read_folder(spark, folder, files_per_trigger=1)
        run_stream(stream, CALM, root, stop_on_halt=False, available_now=True).awaitTermination()

    land(parts[0], folder)
    run()
    for part in parts[1:]:
        land(part, folder)
    run()

    table = stage(signals(events, CALM))
    want = hi.history_rows(table)
    got = spark.read.parquet(f"{root}/history")
    assert rows_of(got, want.columns) == rows_of(want, want.columns)

    columns = ["feed", "batch_id", "rule", "level", "streak", "runbook_key"]
    fired = al.alerts(table, CALM).unionByName(al.halt_alert_rows(table))
    assert rows_of(spark.read.parquet(f"{root}/alerts"), columns) == rows_of(fired, columns)

    totals = table.agg(F.sum("passed"), F.sum("quarantined")).first()
    clean, dead = (spark.read.parquet(f"{root}/{n}") for n in ("clean", "dead"))
    assert (clean.count(), dead.count()) == tuple(totals)
    assert spark.read.parquet(f"{root}/shadow").count() > 0
    # Metrics and panels of the stream are those of the table.
    kept = spark.read.parquet(f"{root}/signals").drop("epoch")
    for made in (
        me.counters, me.histograms, me.records_rate, me.quality_series, me.latency_bucket_rates,
        lambda h: me.threshold_series(h, CALM), lambda h: me.latest_gauges(h, CALM),
    ):
        want_rows = made(table)
        assert rows_of(made(kept), want_rows.columns) == rows_of(want_rows, want_rows.columns)
    late = events.filter(F.col("received_at") - F.col("occurred_at") > CALM.max_allowed_lag_ms).count()
    assert spark.read.parquet(f"{root}/late").count() == late > 0
    # State that no epoch needs any more is gone.
    assert {r[0] for r in spark.read.parquet(f"{root}/state").select("epoch").distinct().collect()} == {1, 2}

    # The last epoch runs again: nothing changes.
    Gate(CALM, root, stop_on_halt=False)(parts[2], 2)
    assert rows_of(spark.read.parquet(f"{root}/history"), want.columns) == rows_of(want, want.columns)
    assert spark.read.parquet(f"{root}/clean").count() == totals[0]
    events.unpersist()


def event(seq, kind="good", at=1_705_314_600_000, event_id=None):
    payload = json.dumps({"user_id": "u", "timestamp": "2024-01-15", "price": -1 if kind == "bad" else 1})
    return {
        "event_id": event_id or f"e{seq}", "event_type": None if kind == "broken" else "t", "event_version": 1,
        "producer": "p", "occurred_at": at, "partition_key": "k", "payload_json": payload, "trace_id": None,
        "headers": None, "seq": seq, "received_at": at + 10,
    }


LIVE = [f for f in EVENTS.fieldNames() if f not in ("feed", "batch_id")]


def live(spark, rows):
    return spark.createDataFrame(rows, EVENTS).select(*LIVE)


def test_halt_stops_until_reset(spark, tmp_path):
    root, resets = str(tmp_path / "out"), str(tmp_path / "resets")
    p = DAYS.but(short_window_seconds=60, baseline_window_seconds=3600)
    bad = live(spark, [event(100 + i, "broken" if i < 5 else "good") for i in range(10)])
    loose = Gate(p, root, stop_on_halt=False)
    for epoch in range(3):
        loose(bad, epoch)
    gate = Gate(p, root, resets=resets)
    good = live(spark, [event(i) for i in range(10)])
    # The breaker is open now: a good batch halts, and again when retried.
    for _ in range(2):
        with pytest.raises(RuntimeError, match="halted"):
            gate(good, 3)
    rows = spark.read.parquet(f"{root}/history").orderBy("batch_id").collect()
    assert [r["outcome"] for r in rows] == ["halt"] * 4
    alerts = spark.read.parquet(f"{root}/alerts").filter("rule = 'halt'").collect()
    assert [r["batch_id"] for r in alerts] == [0]
    assert spark.read.parquet(f"{root}/clean").filter("epoch = 3").isEmpty()
    assert spark.read.parquet(f"{root}/halted").count() == 30
    assert spark.read.parquet(f"{root}/halts").filter("epoch = 3").count() == 1

    spark.createDataFrame([("main", 3)], "feed string, batch_id bigint").write.parquet(resets)
    gate(good, 3)
    rows = spark.read.parquet(f"{root}/history").orderBy("batch_id").collect()
    assert [r["outcome"] for r in rows] == ["halt"] * 3 + ["pass"]
    assert spark.read.parquet(f"{root}/clean").filter("epoch = 3").count() == 10


def test_a_stopped_stream_does_not_commit(spark, tmp_path):
    root, folder = str(tmp_path / "out"), str(tmp_path / "in")
    land(live(spark, [event(i, "broken") for i in range(4)]), folder)
    schema = live(spark, []).schema
    for _ in range(2):
        query = run_stream(read_folder(spark, folder, schema), DAYS, root, available_now=True)
        with pytest.raises(StreamingQueryException, match="halted"):
            query.awaitTermination()
    commits = tmp_path / "out" / "checkpoint" / "commits"
    assert not commits.exists() or not [f for f in commits.iterdir() if not f.name.startswith(".")]
    assert spark.read.parquet(f"{root}/history").count() == 1


def test_dedup_across_epochs_and_dry_run(spark, tmp_path):
    p = DAYS.but(dedup_window_seconds=60)
    t0 = 1_705_314_600_000
    gate = Gate(p, str(tmp_path / "out"), skew_seconds=0)
    gate(live(spark, [event(1, at=t0, event_id="a"), event(2, at=t0 + 1000, event_id="a"), event(3, at=t0, event_id="b")]), 0)
    gate(live(spark, [event(4, at=t0 + 60_000, event_id="a"), event(5, at=t0 + 60_001, event_id="b")]), 1)
    gate(live(spark, [event(6, at=t0 + 60_002, event_id="a"), event(7, at=t0 + 60_003, event_id="b")]), 2)
    clean = spark.read.parquet(str(tmp_path / "out" / "clean")).orderBy("epoch")
    got = [(r["epoch"], json.loads(r["value"])["event_id"]) for r in clean.collect()]
    assert sorted(got) == [(0, "a"), (0, "b"), (1, "b"), (2, "a")]
    # Much later: keys out of reach are accepted again and their slots are gone.
    gate(live(spark, [event(8, at=t0 + 600_000, event_id="a")]), 3)
    assert spark.read.parquet(str(tmp_path / "out" / "clean")).filter("epoch = 3").count() == 1
    slots = [f.name for f in (tmp_path / "out" / "accepted_clean").iterdir() if f.name.startswith("slot=")]
    assert slots == [f"slot={(t0 + 600_010) // 60_000}"]

    dry = Gate(DAYS.but(mode="dry_run"), str(tmp_path / "dry"))
    dry(live(spark, [event(i, "broken") for i in range(3)]), 0)
    assert spark.read.parquet(str(tmp_path / "dry" / "history")).first()["outcome"] == "halt"
    assert not (tmp_path / "dry" / "clean").exists()
    dry(live(spark, []), 1)
    assert spark.read.parquet(str(tmp_path / "dry" / "history")).count() == 1


def test_transport_rows_decode_with_their_position(spark):
    rows = [("in", 1, 5, "k", json.dumps({"event_id": "e"}).encode()), ("in", 0, 6, "k", None)]
    raw = spark.createDataFrame(rows, "topic string, partition int, offset bigint, key string, value binary")
    raw = raw.withColumn("timestamp", F.timestamp_millis(F.lit(1234)))
    got = from_transport(raw).collect()
    assert [(r["feed"], r["event_id"], r["received_at"], r["seq"]) for r in got] == [("in", "e", 1234, 5 * 65_536 + 1)]


def test_builtin_stream_dedup_runs(spark, tmp_path):
    folder = str(tmp_path / "in")
    land(spark.sql("SELECT 'a' AS k, timestamp'2024-01-01 00:00:00' AS at UNION ALL SELECT 'a', timestamp'2024-01-01 00:00:01'"), folder)
    stream = spark.readStream.schema("k string, at timestamp").parquet(folder)
    query = dedup_stream(stream, "k", "at", 60).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT * FROM once").count() == 1


def test_a_halt_class_batch_is_released(spark, tmp_path):
    root, folder, resets = (str(tmp_path / n) for n in ("out", "in", "resets"))
    land(live(spark, [event(i, "broken") for i in range(4)]), folder)
    schema = live(spark, []).schema

    def run():
        query = run_stream(read_folder(spark, folder, schema), DAYS, root, resets=resets, available_now=True)
        query.awaitTermination()

    with pytest.raises(StreamingQueryException, match="halted"):
        run()
    asked = "feed string, batch_id bigint, action string"
    spark.createDataFrame([("main", 0, "retry")], asked).write.parquet(resets)
    with pytest.raises(StreamingQueryException, match="halted"):
        run()
    spark.createDataFrame([("main", 0, "release")], asked).write.mode("append").parquet(resets)
    run()
    assert spark.read.parquet(f"{root}/halted").count() == 4
    assert spark.read.parquet(f"{root}/halts").count() == 1
    assert spark.read.parquet(f"{root}/history").first()["outcome"] == "halt"
    commits = tmp_path / "out" / "checkpoint" / "commits"
    assert [f for f in commits.iterdir() if not f.name.startswith(".")]


def test_other_batches_of_a_halted_epoch_are_written(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = [event(i, "broken") for i in range(4)] + [event(10 + i) for i in range(5)]
    feeds = spark.createDataFrame(rows, EVENTS).withColumn("feed", F.when(F.col("seq") < 10, "a").otherwise("b"))
    with pytest.raises(RuntimeError, match="halted"):
        Gate(DAYS, root)(feeds.drop("batch_id"), 0)
    assert spark.read.parquet(f"{root}/clean").count() == 5


def test_no_record_is_lost(spark, tmp_path):
    root = str(tmp_path / "out")
    good = json.dumps({k: v for k, v in event(1).items() if k not in ("seq", "received_at") and v is not None})
    values = ["x", "x", "{", good + " x", good + good] + [good.replace('"e1"', f'"e{i}"') for i in range(5)]
    raw = spark.createDataFrame(
        [(t, 0, i, "k", v.encode()) for t in ("left", "right") for i, v in enumerate(values)],
        "topic string, partition int, offset bigint, key string, value binary",
    ).withColumn("timestamp", F.timestamp_millis(F.lit(1_705_314_600_010)))
    gate = Gate(CALM.but(schema_rate_critical=2.0), root)
    gate(from_transport(raw), 0)
    sums = spark.read.parquet(f"{root}/history").agg(F.sum("passed"), F.sum("quarantined")).first()
    assert tuple(sums) == (10, 10)
    letters = spark.read.parquet(f"{root}/dead").select("value").collect()
    assert sorted(json.loads(r["value"])["original_payload_json"] for r in letters) == sorted(values[:5] * 2)
    offsets = spark.read.parquet(f"{root}/offsets").collect()
    assert sorted((r["topic"], r["offset_first"], r["offset_last"]) for r in offsets) == [("left", 0, 9), ("right", 0, 9)]
    # The same events in both feeds are duplicates; positions of one feed do not touch the other.
    assert spark.read.parquet(f"{root}/clean").count() == 5
