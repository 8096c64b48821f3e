"""Keyed state, event-time windows and progress of running streams, against the tables."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from dqstream.operators.dedup import dedup_window
from dqstream.operators.volume import volume_vs_baseline
from dqstream.policy import starter
from dqstream.sources import fixtures as fx
from dqstream.sources.readers import EVENTS, read_folder
from dqstream.streaming import once
from dqstream.streaming.gate import Gate, run_stream, with_heartbeats
from dqstream.streaming.progress import ProgressTable, live_lag, live_latency, offsets_of, read_progress
from dqstream.streaming.windows import volume_vs_baseline_stream

# A heartbeat every minute, against a window of a minute and a baseline of ten.
QUIET = starter().but(short_window_seconds=60, baseline_window_seconds=600, stall_min_volume=1, flag_outage=True)
FAR = 4_000_000_000_000
RECORDS = "key string, at bigint, feed string, seq bigint, body string"


@pytest.fixture
def rocks(spark):
    before = {k: spark.conf.get(k, None) for k in once.STORE}
    for k, v in once.STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def land(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)
    time.sleep(1.1)


def run(frame, name, root):
    """Write what the stream gives to `root/name`; goes on where an earlier run stopped."""
    writer = frame.writeStream.queryName(name).format("parquet").outputMode("append").trigger(availableNow=True)
    query = writer.option("checkpointLocation", f"{root}/check").start(f"{root}/{name}")
    query.awaitTermination()
    return query


def records(seed):
    """Two partitions, the second of which lags behind by up to 200 seconds, dealt over three files."""
    rng = random.Random(seed)
    rows = [(f"k{rng.randint(0, 12)}", rng.randint(0, 3000) * 1000, "main", i, f"b{i}") for i in range(300)]
    rows += [(k, t, "main", 1000 + s, b) for k, t, _, s, b in rng.sample(rows, 60)]
    rows += [(None, 5000, "main", 2000, "no key"), ("k1", None, "main", 2001, "no time")]
    at = {r: (r[1] or 0) + (200_000 if r[3] % 2 else 0) for r in rows}
    return [[r for r in rows if low <= at[r] < low + 1_100_000] for low in (0, 1_100_000, 2_200_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_state_accepts_what_the_table_accepts(rocks, tmp_path, seed):
    spark, folder, root = rocks, str(tmp_path / "in"), str(tmp_path)
    files = records(seed)

    def frame():
        stream = read_folder(spark, folder, schema=spark.createDataFrame([], RECORDS).schema, files_per_trigger=1)
        return once.accept_once(stream, "key", "at", ["feed", "seq"], 60, 300)

    land(spark.createDataFrame(files[0], RECORDS), folder)
    run(frame(), "clean", root)
    first = spark.read.parquet(f"{root}/clean").count()
    for part in (*files[1:], [("end", FAR, "main", 9999, "end")]):
        land(spark.createDataFrame(part, RECORDS), folder)
    run(frame(), "clean", root)

    rows = [r for part in files for r in part]
    table = spark.createDataFrame([r for r in rows if r[0] and r[1] is not None], RECORDS)
    want = {r["seq"] for r in dedup_window(table, "key", "at", ["feed", "seq"], 60).collect()} | {2000, 2001}
    got = [r["seq"] for r in spark.read.parquet(f"{root}/clean").collect()]
    assert sorted(s for s in got if s != 9999) == sorted(want)
    assert 0 < first < len(want) < len(rows)


def test_timers_evict_keys_that_are_out_of_reach(rocks, tmp_path):
    spark, folder, root = rocks, str(tmp_path / "in"), str(tmp_path)
    schema = spark.createDataFrame([], RECORDS).schema
    for start in (1_000, 10_000_000, 20_000_000):
        land(spark.createDataFrame([(f"k{start}-{i}", start + i, "main", start + i, "b") for i in range(200)], RECORDS), folder)
    land(spark.createDataFrame([("end", FAR, "main", 1, "end")], RECORDS), folder)
    stream = read_folder(spark, folder, schema=schema, files_per_trigger=1)
    query = run(once.accept_once(stream, "key", "at", ["feed", "seq"], 60, 10), "clean", root)
    told = [json.loads(p.json)["stateOperators"] for p in query.recentProgress]
    assert spark.read.parquet(f"{root}/clean").where("key <> 'end'").count() == 600
    held = [o[0]["numRowsTotal"] for o in told if o]
    # No epoch holds the keys of all three bursts.
    assert max(held) < 3 * 200 * 3 and held[-1] < 200


def test_windows_of_a_finished_stream_equal_the_table(spark, sf_dir, tmp_path):
    p = starter().but(short_window_seconds=3600, baseline_window_seconds=86_400, stall_drop_ratio=0.4)
    events = fx.thinned(fx.envelopes(spark, sf_dir)).select(*EVENTS.fieldNames()).persist()
    folder, root = str(tmp_path / "in"), str(tmp_path)
    ordered = events.orderBy("occurred_at").collect()
    half = len(ordered) // 2

    def frame():
        return volume_vs_baseline_stream(read_folder(spark, folder, files_per_trigger=1), p, 120)

    land(spark.createDataFrame(ordered[:half], EVENTS), folder)
    run(frame(), "volumes", root)
    end = {**ordered[-1].asDict(), "occurred_at": FAR}
    late = {**ordered[0].asDict(), "event_id": "late"}
    land(spark.createDataFrame(ordered[half:], EVENTS), folder)
    land(spark.createDataFrame([tuple(late[c] for c in EVENTS.fieldNames())], EVENTS), folder)
    land(spark.createDataFrame([tuple(end[c] for c in EVENTS.fieldNames())], EVENTS), folder)
    query = run(frame(), "volumes", root)

    columns = ["feed", "bucket_start", "events", "stalling"]
    want = volume_vs_baseline(events, p).collect()
    got = spark.read.parquet(f"{root}/volumes").where(f"bucket_start < {FAR - 3_600_000}").collect()
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(tuple(r[c] for c in columns) for r in want)
    average = {(r["feed"], r["bucket_start"]): r["baseline_avg"] for r in want}
    assert all(r["baseline_avg"] == pytest.approx(average[r["feed"], r["bucket_start"]]) for r in got)
    # The late event is left out and counted.
    told = [json.loads(t.json)["stateOperators"] for t in query.recentProgress]
    assert sum(o.get("numRowsDroppedByWatermark", 0) for ops in told for o in ops) == 1


def test_lag_and_latency_of_a_running_folder_stream(spark, sf_dir, tmp_path):
    folder, table = str(tmp_path / "in"), str(tmp_path / "progress")
    events = fx.envelopes(spark, sf_dir).select(*EVENTS.fieldNames())
    for third in range(3):
        land(events.where(F.col("seq") % 3 == third), folder)
    listener = ProgressTable(spark, table)
    spark.streams.addListener(listener)
    try:
        stream = read_folder(spark, folder, files_per_trigger=1)
        run(stream, "gate", str(tmp_path))
        land(events.where("seq % 10 = 0"), folder)
        deadline = time.time() + 60
        while time.time() < deadline:
            try:
                if read_progress(spark, table).where("input_rows > 0").count() == 3:
                    break
            except Exception:  # the folder appears with the first row
                pass
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    progress = read_progress(spark, table)
    total, more = events.count(), events.where("seq % 10 = 0").count()
    assert progress.agg(F.sum("input_rows")).first()[0] == total
    landed = read_folder(spark, folder, streaming=False)
    for limit, flag in ((more - 1, True), (more, False), (0, False)):
        lag = live_lag(progress, starter().but(throttle_on_lag=limit), landed).collect()
        assert [(r["topic"], r["consumer_lag"], r["backpressure"]) for r in lag] == [("gate", more, flag)]
    latency = live_latency(progress).collect()
    assert len(latency) == 3 and all(r["latency_ms"] > 0 and r["rows_per_second"] > 0 for r in latency)


def test_lag_of_a_topic_source_comes_from_its_offsets(spark):
    source = {"endOffset": {"raw": {"0": 5, "1": 7}}, "latestOffset": json.dumps({"raw": {"0": 9, "1": 7, "2": 4}})}
    offsets = offsets_of(source)
    assert [(o["partition"], o["committed"], o["high"]) for o in offsets] == [(0, 5, 9), (1, 7, 7), (2, None, 4)]
    assert offsets_of({"endOffset": {"logOffset": 3}}) == [] and offsets_of({}) == []
    rows = [("q", 0, []), ("q", 1, [(o["topic"], o["partition"], o["committed"], o["high"]) for o in offsets])]
    schema = "query string, epoch bigint, offsets array<struct<topic:string,partition:int,committed:bigint,high:bigint>>"
    lag = live_lag(spark.createDataFrame(rows, schema), starter().but(throttle_on_lag=7)).collect()
    assert [(r["topic"], r["consumer_lag"], r["backpressure"]) for r in lag] == [("raw", 8, True)]


def quiet_frame(spark, seqs, at, beat):
    """Events at `at`, and one heartbeat at `beat`."""
    payload = json.dumps({"user_id": "u", "timestamp": "2024-01-15", "price": 1})
    events = spark.createDataFrame(
        [(f"e{i}", "t", 1, "p", at, "k", payload, None, None, i, at + 10, False) for i in seqs],
        "event_id string, event_type string, event_version int, producer string, occurred_at bigint, partition_key string,"
        " payload_json string, trace_id string, headers map<string,string>, seq bigint, received_at bigint, heartbeat boolean",
    )
    beats = spark.createDataFrame([(beat, True)], "received_at bigint, heartbeat boolean")
    return events.unionByName(beats, allowMissingColumns=True)


@pytest.mark.parametrize("flagged", [True, False])
def test_silence_is_judged_by_heartbeats(spark, tmp_path, flagged):
    root, t0 = str(tmp_path / "out"), 1_705_314_600_000
    gate = Gate(QUIET.but(flag_outage=flagged), root)
    gate(quiet_frame(spark, range(20), t0, t0 + 20), 0)
    last = 5 if flagged else 3
    for epoch in range(1, last):
        gate(quiet_frame(spark, [], t0, t0 + epoch * 90_000), epoch)
    gate(quiet_frame(spark, range(100, 120), t0 + last * 90_000, t0), last)
    rows = spark.read.parquet(f"{root}/signals").orderBy("batch_id").collect()
    assert [r["total_records"] for r in rows] == [20, *[0] * (last - 1), 20]
    assert [r["clock"] for r in rows][1:last] == [t0 + e * 90_000 for e in range(1, last)]
    # After three minutes the short window is empty.
    assert [r["short_volume"] for r in rows][2:last] == [0] * (last - 2)
    assert [r["stall_active"] for r in rows][2:last] == [flagged] * (last - 2) and not rows[last]["stall_active"]
    assert [r["outcome"] for r in rows] == ["pass"] * (last + 1)
    fired = [r["rule"] for r in spark.read.parquet(f"{root}/alerts").collect()]
    assert ("stall" in fired) == flagged
    history = spark.read.parquet(f"{root}/history")
    assert history.count() == last + 1 and history.filter("total_records = 0 AND null_rate = 0").count() == last - 1


def test_a_running_stream_without_events_goes_on_judging(spark, tmp_path):
    root, folder = str(tmp_path / "out"), str(tmp_path / "in")
    frame = quiet_frame(spark, range(5), int(time.time() * 1000) - 5000, 0).filter("NOT heartbeat").drop("heartbeat")
    land(frame, folder)
    stream = with_heartbeats(read_folder(spark, folder, frame.schema), "main")
    query = run_stream(stream, QUIET.but(batch_timeout_ms=500, short_window_seconds=1), root)
    try:
        deadline, empty = time.time() + 90, 0
        while time.time() < deadline and empty < 2:
            time.sleep(1)
            assert query.exception() is None
            done = [d for d in (tmp_path / "out" / "signals").glob("epoch=*/_SUCCESS")] if (tmp_path / "out" / "signals").exists() else []
            empty = spark.read.parquet(*[str(d.parent) for d in done]).filter("total_records = 0").count() if done else 0
    finally:
        query.stop()
    assert empty >= 2
    assert spark.read.parquet(f"{root}/clean").count() == 5
