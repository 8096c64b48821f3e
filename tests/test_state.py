"""Breaker, alerts, lag and volume against step-by-step walks."""

from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from dqstream.operators import alerts as al
from dqstream.operators import batches as ba
from dqstream.operators import breaker as br
from dqstream.operators import lag as la
from dqstream.operators import volume as vo
from dqstream.operators.anomaly import anomaly
from dqstream.policy import starter
from dqstream.sources.readers import EVENTS

REPORT = (
    "feed string, batch_id bigint, quarantined bigint, null_rate_warning boolean, null_rate_critical boolean, "
    "schema_rate_warning boolean, schema_rate_critical boolean"
)


def report_rows(seed, n=60):
    rng = random.Random(seed)
    out, at = [], 0
    for _ in range(n):
        at += rng.randint(1, 3)
        kind = rng.choice(["pass", "pass", "quarantine", "halt", "halt"])
        out.append(("f", at, int(kind == "quarantine"), False, rng.random() < 0.4, False, kind == "halt"))
    return out


def walk_breaker(rows, resets):
    latch, streak, out, left = False, 0, {}, sorted(resets)
    for _, at, quarantined, *_flags, critical in rows:
        while left and left[0] <= at:
            latch, streak = False, 0
            left.pop(0)
        if latch:
            out[at] = "halt"
        elif critical:
            streak += 1
            latch = streak >= 3
            out[at] = "halt"
        elif quarantined:
            streak += 1
            out[at] = "quarantine"
        else:
            streak = 0
            out[at] = "pass"
    return out


@pytest.mark.parametrize("seed,span", [(1, 5), (2, 1000), (3, None)])
def test_breaker_with_resets(spark, seed, span):
    rows = report_rows(seed)
    resets = [20, 21, 55, 90]
    control = spark.createDataFrame([("f", r) for r in resets], "feed string, batch_id bigint")
    report = spark.createDataFrame(rows, REPORT)
    for given, df in ((resets, control), ([], None)):
        got = {r["batch_id"]: r["outcome"] for r in br.breaker(report, starter(), df, span=span).collect()}
        assert got == walk_breaker(rows, given)


def test_breaker_goes_on_from_stored_state(spark):
    rows = report_rows(4)
    resets = [25, 60]
    control = spark.createDataFrame([("f", r) for r in resets], "feed string, batch_id bigint")
    cut = rows[25][1]
    first = br.breaker(
        spark.createDataFrame([r for r in rows if r[1] <= cut], REPORT), starter(), control.filter(F.col("batch_id") <= cut)
    )
    state = first.orderBy(F.desc("batch_id")).limit(1)
    later = br.breaker(
        spark.createDataFrame([r for r in rows if r[1] > cut], REPORT),
        starter(),
        control.filter(F.col("batch_id") > cut),
        state,
        span=None,
    )
    got = {r["batch_id"]: r["outcome"] for r in first.unionByName(later).collect()}
    assert got == walk_breaker(rows, resets)


def test_three_halts_open_and_quarantines_count_towards_it(spark):
    halt, hold, good = (0, False, False, False, True), (1, False, False, False, False), (0,) + (False,) * 4

    def outcomes(p, *kinds):
        rows = [("f", i, *k) for i, k in enumerate(kinds)]
        got = br.breaker(spark.createDataFrame(rows, REPORT), p).orderBy("batch_id").collect()
        return [r["outcome"] for r in got]

    p = starter()
    assert outcomes(p, halt, halt, halt, good) == ["halt"] * 4
    assert outcomes(p, halt, halt, good, halt) == ["halt", "halt", "pass", "halt"]
    assert outcomes(p, hold, hold, halt, good) == ["quarantine", "quarantine", "halt", "halt"]
    assert outcomes(p, hold, hold, hold, good) == ["quarantine"] * 3 + ["pass"]
    assert outcomes(p.but(halt_on_quarantine_run=True), hold, hold, hold, good) == ["quarantine"] * 2 + ["halt"] * 2
    assert outcomes(p.but(halt_on=()), halt) == ["pass"]


def test_rates_and_flags(spark):
    def events(*lists):
        return spark.createDataFrame([("f", 1, v, not v) for v in lists], "feed string, batch_id bigint, violations array<string>, is_valid boolean")

    missing, broken, wrong = ["missing_required_field"], ["schema_violation"], ["invalid_field_value"]
    r = ba.batch_report(events(*[missing] * 3, *[[]] * 7), starter()).first()
    assert r["null_rate"] == 0.1 and r["null_rate_critical"] and r["passed"] == 7 and r["quarantined"] == 3
    r = ba.batch_report(events(*[broken] * 3, *[[]] * 7), starter()).first()
    assert r["schema_violation_rate"] == 0.3 and r["schema_rate_critical"] and r["schema_rate_warning"]
    r = ba.batch_report(events(missing * 3, wrong + missing, broken * 2), starter()).first()
    assert (r["missing_required_fields"], r["invalid_field_values"], r["schema_violations"]) == (4, 1, 1)
    r = ba.batch_report(events([], []), starter(null_rate_warning=0.0, null_rate_critical=0.0)).first()
    assert r["null_rate_critical"] and r["null_rate_warning"] and not r["schema_rate_warning"]
    r = ba.batch_report(events(missing), starter(required_fields=())).first()
    assert r["null_rate"] == 0.0
    assert ba.batch_report(events(missing).filter("false"), starter()).count() == 0


def event_rows(seed, batches=25, feeds=("f",)):
    """Out-of-order event times, growing receive times, empty batches left out."""
    rng = random.Random(seed)
    out, seq = [], 0
    for feed in feeds:
        clock = 1_000_000
        for b in range(batches):
            for _ in range(rng.choice([0, 1, 2, 5, 8])):
                clock += rng.randint(0, 900)
                occurred = clock - rng.choice([0, 0, 50, 700, 4000, 9000, 40_000, -300])
                out.append((feed, b, seq, occurred, clock))
                seq += 1
            clock += rng.choice([0, 500, 6000])
    return out


def event_frame(spark, rows):
    df = spark.createDataFrame(rows, "feed string, batch_id bigint, seq bigint, occurred_at bigint, received_at bigint")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in EVENTS.fields if f.name not in df.columns]
    return df.select("*", *empty)


WINDOWS = starter(short_window_seconds=5, baseline_window_seconds=30, stall_min_volume=3, max_allowed_lag_ms=3000)


def walk_volumes(rows, p):
    """Keep every event; drop it for good once a clock has passed it."""
    short, base = p.short_window_seconds * 1000, p.baseline_window_seconds * 1000
    out, in_short, in_base, clock = {}, [], [], 0
    stall, first = 0, None
    for b in sorted({r[1] for r in rows}):
        mine = [r for r in rows if r[1] == b]
        in_short += [r[3] for r in mine]
        in_base += [r[3] for r in mine]
        clock = max([clock] + [r[4] for r in mine])
        in_short = [t for t in in_short if (t // short + 1) * short > clock - short]
        in_base = [t for t in in_base if t >= clock - base]
        average = len(in_base) / max(base / short, 1)
        drop = 1.0 - len(in_short) / average if average > 0 else 0.0
        if len(in_short) >= p.stall_min_volume and drop >= p.stall_drop_ratio:
            stall += 1
            first = first or (len(in_short), average, drop)
        else:
            stall, first = 0, None
        out[b] = (len(in_short), len(in_base), stall, first)
    return out


@pytest.mark.parametrize("seed,span", [(1, 4), (2, 1000), (3, None), (4, 2)])
def test_volumes_and_stalls(spark, seed, span):
    p = WINDOWS.but(stall_drop_ratio=0.1)
    rows = event_rows(seed, batches=40)
    counted = vo.volumes(vo.volume_grid(event_frame(spark, rows)), p, span=span)
    got = {}
    for r in vo.stall_signal(counted, p, span=span).collect():
        first = (r["stall_short_volume"], r["stall_baseline_avg"], r["stall_drop_ratio"]) if r["stall_active"] else None
        got[r["batch_id"]] = (r["short_volume"], r["baseline_total"], r["stall_streak"], first)
    assert got == walk_volumes(rows, p)


def test_an_outage_is_a_stall_only_on_request(spark):
    rows = [("f", 1, 1_000, 1, 20)]
    counted = spark.createDataFrame(rows, "feed string, batch_id bigint, clock bigint, short_volume bigint, baseline_total bigint")
    assert not vo.stall_columns(counted, WINDOWS).first()["stalled"]
    assert vo.stall_columns(counted, WINDOWS.but(flag_outage=True)).first()["stalled"]


def walk_lag(rows, p):
    recent, out = deque(maxlen=p.lag_samples), {}
    total = late = worst = 0
    for b in sorted({r[1] for r in rows}):
        lags = [max(r[4] - r[3], 0) for r in rows if r[1] == b]
        total, late, worst = total + len(lags), late + sum(x > p.max_allowed_lag_ms for x in lags), max([worst, *lags])
        recent.extend(lags)
        ordered = sorted(recent)
        out[b] = (total, late, worst, float(ordered[int(len(ordered) * 0.95)]), len(ordered))
    return out


@pytest.mark.parametrize("seed,span,samples", [(1, 3, 1000), (2, 1000, 10), (3, None, 7), (4, 2, 1)])
def test_lag_totals_and_rolling_p95(spark, seed, span, samples):
    p = WINDOWS.but(lag_samples=samples)
    rows = event_rows(seed)
    df = event_frame(spark, rows)
    totals = la.lag_running(la.lag_batches(df, p), span=span)
    p95 = la.lag_p95(la.lag_tails(df, p), p, span=span)
    got = {
        r["batch_id"]: (
            r["total_event_count"], r["late_event_count"], r["max_seen_lag_ms"], r["p95_lag_ms"], r["sample_count"],
        )
        for r in totals.join(p95, ["feed", "batch_id"]).collect()
    }
    assert got == walk_lag(rows, p)


def test_lag_exactly_at_the_limit_is_not_late(spark):
    df = event_frame(spark, [("f", 1, 1, 0, 3000), ("f", 1, 2, 0, 3001), ("f", 1, 3, 500, 0)])
    r = la.lag_batches(df, WINDOWS).first()
    assert (r["event_count"], r["late_count"], r["batch_max_lag_ms"]) == (3, 1, 3001)
    on_time, late = la.split_late(df, WINDOWS)
    assert (on_time.count(), late.count()) == (2, 1)


SIGNALS = (
    "feed string, batch_id bigint, stall_active boolean, stall_drop_ratio double, max_seen_lag_ms bigint, "
    "total_event_count bigint, late_ratio double, total_records bigint, quarantined bigint, "
    "null_rate_critical boolean, schema_rate_critical boolean, clock bigint"
)


@pytest.mark.parametrize(
    "row,volume,lag,violation",
    [
        ((True, 0.6, 0, 5, 0.0, 5, 0, False, False), 1.0, 0.0, 0.0),
        ((True, 0.3, 0, 5, 0.0, 5, 0, False, False), 0.0, 0.0, 0.0),
        ((False, 0.6, 30000, 5, 0.0, 5, 1, False, False), 0.0, 0.25, 1 / 3),
        ((False, 0.0, 60000, 5, 0.1, 5, 1, True, False), 0.0, 0.5, 2 / 3),
        ((False, 0.0, 90000, 5, 0.9, 5, 1, True, True), 0.0, 1.0, 1.0),
        ((False, 0.0, 90000, 0, 0.9, 0, 1, True, True), 0.0, 0.0, 0.0),
    ],
)
def test_score_components(spark, row, volume, lag, violation):
    p = starter(score_threshold=0.25)
    r = anomaly(spark.createDataFrame([("f", 1, *row, 77)], SIGNALS), p).first()
    assert (r["volume_score"], r["lag_score"]) == (volume, lag)
    assert r["violation_score"] == pytest.approx(violation)
    total = 0.4 * volume + 0.3 * lag + 0.3 * violation
    assert r["anomaly_score"] == pytest.approx(total)
    assert r["anomaly_active"] == (total >= 0.25) and (r["anomaly_detected_at"] == 77) == (total >= 0.25)
    want = [f"{n}_anomaly(score={s:.2f})" for n, s in (("volume", volume), ("lag", lag), ("violation", violation)) if s >= 0.25]
    assert r["anomaly_details"] == want


ALERTS = (
    "feed string, batch_id bigint, stall_streak bigint, null_rate_critical boolean, schema_rate_critical boolean, "
    "total_event_count bigint, late_ratio double, anomaly_active boolean, outcome string"
)


def walk_alerts(rows, resets, p):
    n = s = g = a = 0
    halted, out, left = False, {}, sorted(resets)
    w, m = p.warning_windows, p.critical_multiplier
    for _, at, stall, nulls, schemas, events, late, odd, outcome in rows:
        while left and left[0] <= at:
            n = s = g = a = 0
            halted = False
            left.pop(0)
        n, s, a = n + 1 if nulls else 0, s + 1 if schemas else 0, a + 1 if odd else 0
        if events:
            g = g + 1 if late > p.late_ratio_critical else 0
        levels = []
        if stall >= w:
            levels.append("stall=" + ("critical" if stall >= w * m else "warning"))
        if n >= w:
            levels.append("null_rate=" + ("critical" if n >= int(w * m) else "warning"))
        if s >= w:
            levels.append("schema=critical")
        if g >= w:
            levels.append("lag=warning")
        if a >= w:
            levels.append("anomaly=warning")
        if outcome == "halt" and not halted:
            halted = True
            levels.append("halt=critical")
        if levels:
            out[at] = levels
    return out


@pytest.mark.parametrize("seed,span", [(1, 4), (2, None)])
def test_alerts_with_resets(spark, seed, span):
    rng = random.Random(seed)
    p = starter(warning_windows=2, critical_multiplier=1.5)
    rows, stall = [], 0
    for at in range(0, 120, 2):
        stall = stall + 1 if rng.random() < 0.7 else 0
        rows.append((
            "f", at, stall, rng.random() < 0.7, rng.random() < 0.6, rng.choice([0, 5, 5]), rng.choice([0.0, 0.02, 0.03, 0.5]),
            rng.random() < 0.6, rng.choice(["pass", "halt"]),
        ))
    resets = [31, 32, 77]
    control = spark.createDataFrame([("f", r) for r in resets], "feed string, batch_id bigint")
    df = spark.createDataFrame(rows, ALERTS)
    everything = al.alerts(df, p, control, span=span).unionByName(al.halt_alert_rows(df, control, span=span))
    got = {r["batch_id"]: list(r["levels"]) for r in al.fired_levels(everything).collect()}
    assert got == walk_alerts(rows, resets, p)


def test_runbooks(spark):
    rows = spark.createDataFrame([("f", 1, "high_lag"), ("f", 2, "strange")], "feed string, batch_id bigint, runbook_key string")
    got = {r["batch_id"]: r["runbook"] for r in al.with_runbook(rows, al.runbook_table(spark)).collect()}
    assert got == {1: al.RUNBOOKS["high_lag"], 2: "strange: no steps are on file"}
