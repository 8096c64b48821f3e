"""One query per operator, each over a whole table of a test folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqstream.contract import BATCH, ENVELOPE
from dqstream.functions import payload as pay
from dqstream.functions import timefmt
from dqstream.operators import alerts as al
from dqstream.operators import anomaly as an
from dqstream.operators import batches as ba
from dqstream.operators import breaker as br
from dqstream.operators import dedup as de
from dqstream.operators import drift as dr
from dqstream.operators import history as hi
from dqstream.operators import intake as it
from dqstream.operators import lag as la
from dqstream.operators import metrics as me
from dqstream.operators import routing as ro
from dqstream.operators import validate as va
from dqstream.operators import volume as vo
from dqstream.operators.signals import signals
from dqstream.plans.scan import span_of
from dqstream.plans.stage import stage
from dqstream.policy import FieldRule, Policy, starter
from dqstream.session import configure
from dqstream.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]

P = starter()
# Events are minutes apart, so the windows are days.
DAYS = starter(
    short_window_seconds=86_400,
    baseline_window_seconds=604_800,
    null_rate_critical=0.03,
    score_threshold=0.5,
    warning_windows=2,
    critical_multiplier=1.5,
    shadow_percentage=0.07,
)
# A later policy that no longer asks for a price.
REPLAY = P.but(
    required_fields=("user_id", "timestamp"),
    field_rules={"timestamp": FieldRule(accepted_formats=("iso8601", "epoch_millis"))},
)

_QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(configure(spark), sf_dir)

    _QUERIES[run.__name__] = configured
    return run


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def joined(codes: str, sep: str = ",") -> Column:
    return F.array_join(codes, sep)


def r6(name: str) -> Column:
    return F.round(name, 6).alias(name)


# ---- intake and decode ----------------------------------------------------


@query
def batch_assign_count(spark, d):
    cut = ba.assign_batches(fx.transport_rows(spark, d), size=100)
    return cut.groupBy(*BATCH).agg(
        F.count(F.lit(1)).alias("records"),
        F.min("offset").alias("offset_first"),
        F.max("offset").alias("offset_last"),
    )


@query
def batch_assign_time(spark, d):
    cut = ba.assign_batches(fx.envelopes(spark, d), span_ms=fx.SIX_HOURS_MS)
    return cut.groupBy(*BATCH).agg(
        F.count(F.lit(1)).alias("records"),
        F.min("received_at").alias("first_received"),
        F.max("received_at").alias("last_received"),
    )


@query
def tombstone_filter(spark, d):
    return va.drop_tombstones(fx.transport_rows(spark, d)).select("partition", "offset", "key")


@query
def envelope_decode_json(spark, d):
    rows = va.decode_envelopes(va.drop_tombstones(fx.transport_rows(spark, d)))
    return rows.select("partition", "offset", *[f for f in ENVELOPE.fieldNames() if f != "headers"])


def spoiled_transport(spark, d):
    """Transport rows whose values, four of five, are not one envelope alone."""
    value = F.col("value")
    kind = F.col("seq") % 5
    spoiled = (
        F.when(kind == 1, F.concat(value, F.lit(" x")))
        .when(kind == 2, F.concat(value, value))
        .when(kind == 3, F.substring(value, 1, 40))
        .when(kind == 4, F.concat(F.lit("["), value, F.lit("]")))
        .otherwise(F.concat(F.lit(" "), value, F.lit("\n")))
    )
    return va.drop_tombstones(fx.transport_rows(spark, d)).withColumn("value", spoiled)


@query
def envelope_decode_strict(spark, d):
    rows = va.check_structure(va.decode_envelopes(spoiled_transport(spark, d)))
    return rows.select("partition", "offset", "event_id", "raw_value", "schema_violation")


@query
def undecodable_dead_letters(spark, d):
    rows = va.decode_envelopes(spoiled_transport(spark, d)).withColumn("batch_id", F.expr("seq div 100"))
    dead = ro.with_dlq_key(va.validate_events(rows, P).filter("raw_value IS NOT NULL"))
    return ro.dlq_records(dead.withColumn("event_id", F.col("idempotency_key"))).select(
        F.col("event_id").alias("idempotency_key"),
        "batch_id",
        joined("reason_codes").alias("reason_codes"),
        "error_detail",
        "original_payload_json",
    )


@query
def envelope_encode_json(spark, d):
    return va.encode_envelopes(fx.envelopes(spark, d)).select("seq", "value")


@query
def envelope_structural_check(spark, d):
    return va.check_structure(fx.envelopes(spark, d)).select("seq", "event_id", "schema_violation")


@query
def occurred_at_normalize(spark, d):
    rows = fx.envelopes(spark, d)
    text = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("t"), F.col("occurred_at").cast("string"))).otherwise(
        F.col("occurred_at").cast("string")
    )
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), "ts")
    from_time = va.normalize_occurred_at(events, "ts").withColumnRenamed("ts", "from_time")
    from_text = va.normalize_occurred_at(rows.select("seq", text.alias("from_text")), "from_text")
    return from_time.join(from_text, "seq", "left").select("seq", "from_time", "from_text")


@query
def batch_offset_context(spark, d):
    rows = fx.transport_rows(spark, d).withColumn("batch_id", F.expr("seq div 100"))
    return ba.offset_context(rows)


@query
def consumer_lag(spark, d):
    return it.consumer_lag(*fx.source_offsets(spark, d))


@query
def backpressure_flag(spark, d):
    return it.backpressure_flag(it.consumer_lag(*fx.source_offsets(spark, d)), P.but(throttle_on_lag=1000))


# ---- record checks ---------------------------------------------------------


@query
def json_parse_check(spark, d):
    text = F.col("payload_json")
    kind = F.col("seq") % 7
    spoiled = (
        F.when(kind == 1, F.concat(text, F.lit(" x")))
        .when(kind == 2, F.concat(text, F.lit("]")))
        .when(kind == 3, F.concat(text, F.lit("}")))
        .when(kind == 4, F.concat(text, F.lit(","), text))
        .when(kind == 5, F.substring(text, 1, 20))
        .otherwise(F.concat(F.lit(" "), text, F.lit("\n")))
    )
    rows = fx.envelopes(spark, d).select("seq", spoiled.alias("text"))
    parsed = rows.withColumn("wrapped", pay.strict_variant(F.col("text")))
    return parsed.select("seq", pay.is_strict(F.col("wrapped"), F.col("text")).alias("is_json"))


def _codes(spark, d, p: Policy = P):
    return va.field_codes(fx.envelopes(spark, d), p)


def where_run(value: Column, kind: str | None = None) -> Column:
    """The value, or null where the rule does not run: no JSON, or no such field."""
    runs = F.col("is_json") if kind is None else F.col("is_json") & ~pay.absent(F.col(kind))
    return F.when(runs, value)


@query
def required_fields(spark, d):
    rows = _codes(spark, d)
    gone = {f"{f}_missing": pay.absent(F.col(f"{f}_kind")) for f in P.required_fields}
    return rows.select("seq", *[where_run(c).alias(n) for n, c in gone.items()])


@query
def number_type_rule(spark, d):
    is_number = pay.is_number_like(F.col("price_kind"))
    return _codes(spark, d).select("seq", where_run(is_number, "price_kind").alias("price_is_number"))


@query
def min_rule(spark, d):
    only_min = P.but(required_fields=("price",), field_rules={"price": FieldRule(min=10)})
    below = F.col("price_code").isNotNull()
    return _codes(spark, d, only_min).select("seq", where_run(below, "price_kind").alias("below_minimum"))


@query
def iso8601_format(spark, d):
    at = F.col("ts").cast("timestamp")
    kind = F.col("event_id") % 8

    def shown(pattern: str) -> Column:
        return F.date_format(at, pattern)

    text = (
        F.when(kind == 0, shown("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 1, shown("yyyy-MM-dd"))
        .when(kind == 2, shown("yyyy-MM-dd HH:mm"))
        .when(kind == 3, shown("yyyy/MM/dd"))
        .when(kind == 4, shown("yyyy-MM-dd'T'HH:mm:ss'+05:30'"))
        .when(kind == 5, shown("yyyy-'13'-dd"))
        .when(kind == 6, shown("yyyy-'02'-dd"))
        .otherwise(shown("yyyy-MM-dd'T24':mm"))
    )
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", text.alias("text"))
    return rows.select("event_id", "text", timefmt.is_iso8601(F.col("text")).alias("is_iso8601"))


@query
def epoch_millis_format(spark, d):
    ms = F.col("occurred_at").cast("string")
    kind = F.col("seq") % 7
    text = (
        F.when(kind == 1, F.concat(F.lit("+"), ms))
        .when(kind == 2, F.concat(F.lit(" "), ms, F.lit(" ")))
        .when(kind == 3, F.concat(ms, F.lit(".5")))
        .when(kind == 4, F.concat(ms, F.lit("000")))
        .when(kind == 5, F.concat(ms, F.lit("000000000000")))
        .when(kind == 6, F.concat(F.lit("-"), ms))
        .otherwise(ms)
    )
    rows = fx.envelopes(spark, d).select("seq", text.alias("text"))
    return rows.select("seq", "text", timefmt.is_epoch_millis(F.col("text")).alias("is_epoch_millis"))


@query
def format_disjunction(spark, d):
    return _codes(spark, d).select(
        "seq",
        where_run(F.col("timestamp_kind") == "STRING", "timestamp_kind").alias("is_text"),
        where_run(F.col("timestamp_code").isNotNull(), "timestamp_kind").alias("fails"),
    )


@query
def field_rule_gating(spark, d):
    return _codes(spark, d).select(
        "seq", *[where_run(F.coalesce(f"{f}_code", F.lit(""))).alias(f"{f}_code") for f in P.required_fields]
    )


@query
def payload_violations(spark, d):
    rows = va.payload_violations(fx.envelopes(spark, d), P)
    return rows.select("seq", joined("violations").alias("violations"))


@query
def valid_events(spark, d):
    return va.validate_events(fx.envelopes(spark, d), P).filter("is_valid").select("seq", "event_id")


@query
def validate_events(spark, d):
    rows = va.validate_events(fx.envelopes(spark, d), P)
    return rows.select("seq", joined("violations").alias("violations"), "is_valid")


@query
def payload_key_drift(spark, d):
    return dr.key_drift(fx.drifted(spark, d), P).select(
        *BATCH, "payload_key", "seen", "total", r6("share"), "status"
    )


@query
def payload_distribution_drift(spark, d):
    return dr.distribution_drift(fx.drifted(spark, d), "price", P.but(drift_z_limit=1.5)).select(
        *BATCH,
        "n",
        *[F.round(c, 8).alias(c) for c in ("mean", "base_mean")],
        *[F.round(c, 4).alias(c) for c in ("spread", "low", "high", "base_spread", "z_score")],
        "base_n",
        "drifted",
    )


@query
def payload_drift_large_values(spark, d):
    # Values around 1.7e12 that spread by a few units, shifted by 1,000 in one batch of ten.
    shift = F.when(F.col("batch_id") % 10 == 8, F.lit(1000)).otherwise(F.lit(0))
    number = F.lit(1_700_000_000_000) + F.col("seq") * 37 % 13 + shift
    rows = fx.envelopes(spark, d).select(
        *BATCH, F.concat(F.lit('{"price": '), number.cast("string"), F.lit("}")).alias("payload_json")
    )
    return dr.distribution_drift(rows, "price", P.but(drift_z_limit=3.0)).select(
        *BATCH,
        "n",
        *[F.round(c, 2).alias(c) for c in ("mean", "base_mean")],
        *[F.round(c, 4).alias(c) for c in ("spread", "base_spread")],
        F.round("z_score", 3).alias("z_score"),
        "base_n",
        "drifted",
    )


@query
def payload_shape_drift(spark, d):
    return dr.shape_drift(fx.widened(spark, d), "price", P).select(
        *BATCH, "n", "base_n", "buckets", r6("psi"), r6("ks"), "drifted"
    )


# ---- batch report ----------------------------------------------------------


def _report(spark, d):
    return ba.batch_report(va.validate_events(fx.envelopes(spark, d), P), P)


@query
def batch_counts(spark, d):
    return _report(spark, d).select(*BATCH, "total_records", "passed", "quarantined")


@query
def batch_missing_count(spark, d):
    return _report(spark, d).select(*BATCH, "missing_required_fields")


@query
def batch_null_rate(spark, d):
    return _report(spark, d).select(*BATCH, r6("null_rate"))


@query
def batch_schema_violation_rate(spark, d):
    return _report(spark, d).select(*BATCH, "schema_violations", r6("schema_violation_rate"))


@query
def batch_invalid_count(spark, d):
    return _report(spark, d).select(*BATCH, "invalid_field_values")


@query
def batch_threshold_flags(spark, d):
    return _report(spark, d).select(
        *BATCH, "null_rate_warning", "null_rate_critical", "schema_rate_warning", "schema_rate_critical"
    )


@query
def empty_batch_stats(spark, d):
    # Batches of four ids. In the days of the drop events join the batch of the last id that
    # five divides, so some batches hold no event at all.
    joined_id = F.when(fx.thin_days(F.col("occurred_at")), F.col("seq") - F.col("seq") % 5).otherwise(F.col("seq"))
    rows = fx.envelopes(spark, d).withColumn("batch_id", F.floor(joined_id / 4))
    report = ba.batch_report(va.validate_events(rows, P), P)
    expected = (
        spark.read.parquet(f"{d}/events.parquet")
        .select(F.lit("main").alias("feed"), F.expr("event_id div 4").alias("batch_id"))
        .distinct()
    )
    return ba.fill_empty(report, expected).select(
        *BATCH, "total_records", "passed", "quarantined", r6("null_rate"), "null_rate_warning", "schema_rate_warning"
    )


@query
def batch_latency(spark, d):
    return ba.batch_latency(fx.envelopes(spark, d))


@query
def window_rate(spark, d):
    hours = vo.tumbling(fx.envelopes(spark, d), 3600).select(
        "feed",
        F.col("bucket_start").alias("window_start"),
        (F.col("bucket_start") + 3_600_000).alias("window_end"),
        F.col("events").alias("record_count"),
    )
    return ba.window_rate(hours).select(
        "feed", "window_start", "window_end", "record_count", r6("volume_per_second")
    )


@query
def batch_quality_report(spark, d):
    return _report(spark, d).select(
        *BATCH,
        "total_records",
        "passed",
        "quarantined",
        "schema_violations",
        "missing_required_fields",
        "invalid_field_values",
        r6("null_rate"),
        r6("schema_violation_rate"),
        "null_rate_warning",
        "null_rate_critical",
        "schema_rate_warning",
        "schema_rate_critical",
    )


# ---- circuit breaker -------------------------------------------------------


def small_report(spark, d):
    """Staged report of batches of ten: passes, quarantines and halts mix."""
    return stage(ba.batch_report(va.validate_events(fx.small_batches(spark, d), DAYS), DAYS))


def resets(spark, d):
    """A manual reset before every two hundredth batch of ten."""
    return (
        spark.read.parquet(f"{d}/events.parquet")
        .filter("event_id div 10 % 200 = 150")
        .select(F.lit("main").alias("feed"), F.expr("event_id div 10").alias("batch_id"))
        .distinct()
    )


def judged(spark, d, control: DataFrame | None = None):
    report = small_report(spark, d)
    return br.breaker(report, DAYS, control, span=span_of(report))


def outcomes(spark, d):
    return stage(judged(spark, d, stage(resets(spark, d))))


@query
def breaker_class(spark, d):
    report = ba.batch_report(va.validate_events(fx.small_batches(spark, d), DAYS), DAYS)
    return br.classify(report, DAYS).select(*BATCH, "batch_class")


@query
def breaker_streak(spark, d):
    report = small_report(spark, d)
    counted = br.failure_streak(br.classify(br.with_resets(report, None), DAYS), span=span_of(report))
    return counted.select(*BATCH, "failure_streak")


@query
def breaker_outcome(spark, d):
    return judged(spark, d).select(*BATCH, "outcome", "breaker_open")


@query
def breaker_with_reset(spark, d):
    rows = judged(spark, d, stage(resets(spark, d)))
    return rows.select(*BATCH, "batch_class", "failure_streak", "outcome", "breaker_open")


@query
def breaker_release(spark, d):
    # Every second reset gives up the batch it stands before; so do some in the middle of a run.
    control = resets(spark, d).unionByName(
        spark.read.parquet(f"{d}/events.parquet")
        .filter("event_id div 10 % 7 = 3")
        .select(F.lit("main").alias("feed"), F.expr("event_id div 10").alias("batch_id"))
        .distinct()
    )
    action = F.when(F.col("batch_id") % 2 == 0, "retry").otherwise("release")
    control = stage(control.distinct().withColumn("action", action))
    rows = stage(judged(spark, d, control))
    held = ro.held_back(rows, control).withColumn("held", F.lit(True))
    return rows.join(held, BATCH, "left").select(
        *BATCH, "outcome", "breaker_open", F.coalesce("held", F.lit(False)).alias("held_back")
    )


# ---- routing ---------------------------------------------------------------


def routes(spark, d):
    checked = va.validate_events(fx.small_batches(spark, d), DAYS)
    return ro.route(checked, outcomes(spark, d), DAYS)


@query
def route_clean(spark, d):
    return routes(spark, d).clean.select(*BATCH, "seq", "event_id")


@query
def route_dlq(spark, d):
    return routes(spark, d).dead.select(*BATCH, "seq", "event_id", joined("violations").alias("violations"))


@query
def dlq_records(spark, d):
    letters = ro.dlq_records(routes(spark, d).dead)
    return letters.withColumn("reason_codes", joined("reason_codes"))


@query
def dlq_reason_counts(spark, d):
    return ro.dlq_reason_counts(routes(spark, d).dead)


@query
def halted_events(spark, d):
    return routes(spark, d).halted.select(*BATCH, "seq", "event_id", "is_valid")


@query
def dry_run_report(spark, d):
    return ro.dry_run_report(outcomes(spark, d))


def keyed_clean(spark, d, p: Policy = DAYS):
    checked = va.validate_events(fx.small_batches(spark, d), p)
    return ro.with_idempotency_key(checked.filter("is_valid"), p)


@query
def idempotency_key(spark, d):
    with_trace = DAYS.but(key_fields=("event_id", "batch_id", "producer", "trace_id"))
    return keyed_clean(spark, d, with_trace).select("seq", "idempotency_key")


@query
def dlq_idempotency_key(spark, d):
    checked = va.validate_events(fx.small_batches(spark, d), DAYS)
    return ro.with_dlq_key(checked.filter("NOT is_valid")).select("seq", "idempotency_key")


def replayed(spark, d):
    rows = ro.with_idempotency_key(fx.replays(spark, d), DAYS)
    return rows.withColumn("row_no", F.col("seq") * 100 + F.col("copy"))


@query
def dedup_window(spark, d):
    rows = replayed(spark, d).select("seq", "copy", "row_no", "idempotency_key", "received_at")
    kept = de.dedup_window(rows, "idempotency_key", "received_at", "row_no", DAYS.dedup_window_seconds)
    return kept.select("seq", "copy", "idempotency_key", "received_at")


@query
def dedup_two_feeds(spark, d):
    # Two feeds whose row numbers collide; keys belong to one feed each.
    feed = F.concat(F.lit("feed-"), (F.col("seq") % 2).cast("string"))
    rows = replayed(spark, d).select(
        feed.alias("feed"), F.expr("row_no div 200 * 100 + copy").alias("row_no"), "idempotency_key", "received_at"
    )
    kept = de.dedup_window(rows, "idempotency_key", "received_at", ["feed", "row_no"], DAYS.dedup_window_seconds)
    return kept.select("feed", "row_no", "idempotency_key", "received_at")


@query
def dedup_first_seen(spark, d):
    rows = replayed(spark, d).select("seq", "copy", "row_no", "idempotency_key", "received_at")
    kept = de.first_seen(rows, ["idempotency_key"], ["received_at", "row_no"])
    return kept.select("seq", "copy", "idempotency_key", "received_at")


@query
def shadow_sample(spark, d):
    return ro.shadow_sample(keyed_clean(spark, d), DAYS).select("seq", "idempotency_key")


@query
def sink_rows(spark, d):
    rows = ro.sink_rows(keyed_clean(spark, d), DAYS.clean_topic)
    header = F.col("headers")[0]
    return rows.select(
        "topic",
        "key",
        "value",
        header["key"].alias("header_key"),
        header["value"].cast("string").alias("header_value"),
    )


@query
def dlq_replay(spark, d):
    rows = va.validate_events(fx.replays(spark, d), P).filter("NOT is_valid")
    letters = ro.dlq_records(rows)
    return ro.replay(letters, REPLAY).select("event_id", joined("violations").alias("violations"), "recovered")


# ---- event-time monitors ---------------------------------------------------


@query
def event_lag(spark, d):
    return la.event_lag(fx.envelopes(spark, d)).select("seq", "lag_ms")


@query
def batch_late_counts(spark, d):
    return la.lag_batches(fx.time_batches(spark, d), P)


def lag_totals(spark, d):
    batches = stage(la.lag_batches(fx.time_batches(spark, d), P))
    return la.lag_running(batches, span=span_of(batches))


@query
def lag_running(spark, d):
    return lag_totals(spark, d).select(*BATCH, "total_event_count", "late_event_count", "max_seen_lag_ms")


@query
def late_ratio(spark, d):
    return lag_totals(spark, d).select(*BATCH, r6("late_ratio"), r6("batch_late_ratio"))


@query
def lag_p95_rolling(spark, d):
    tails = stage(la.lag_tails(fx.envelopes(spark, d), P))
    return la.lag_p95(tails, P, span=span_of(tails))


@query
def volume_tumbling(spark, d):
    return vo.tumbling(fx.thinned(fx.envelopes(spark, d)), 3600)


def day_volumes(spark, d):
    return vo.volumes(stage(vo.volume_grid(fx.time_batches(spark, d, thin=True))), DAYS)


@query
def short_window_volume(spark, d):
    return day_volumes(spark, d).select(*BATCH, "clock", "short_volume")


@query
def baseline_volume(spark, d):
    counted = day_volumes(spark, d).withColumn("baseline_avg", vo.baseline_average(DAYS))
    return counted.select(*BATCH, "baseline_total", r6("baseline_avg"))


@query
def stall_signal(spark, d):
    judged = vo.stall_columns(day_volumes(spark, d), DAYS)
    return judged.select(*BATCH, r6("drop_now"), "stalled")


@query
def stall_streak(spark, d):
    counted = stage(day_volumes(spark, d))
    rows = vo.stall_signal(counted, DAYS, span=span_of(counted))
    return rows.select(
        *BATCH,
        "stall_active",
        "stall_streak",
        "stall_short_volume",
        r6("stall_baseline_avg"),
        r6("stall_drop_ratio"),
        "stall_detected_at",
    )


@query
def window_snapshot(spark, d):
    return vo.window_snapshot(day_volumes(spark, d), DAYS)


@query
def volume_vs_baseline(spark, d):
    hours = DAYS.but(short_window_seconds=3600, baseline_window_seconds=86_400)
    return vo.volume_vs_baseline(fx.thinned(fx.envelopes(spark, d)), hours, span=168).select(
        "feed", "bucket_start", "events", r6("baseline_avg"), r6("drop_ratio"), "stalling"
    )


@query
def late_event_corrections(spark, d):
    rows = la.late_corrections(fx.envelopes(spark, d), P)
    return rows.withColumn("event_date", F.col("event_date").cast("string"))


# ---- score and alerts ------------------------------------------------------


def all_signals(spark, d):
    return signals(fx.thinned(fx.small_batches(spark, d)), DAYS, stage(resets(spark, d)))


@query
def anomaly_components(spark, d):
    return all_signals(spark, d).select(*BATCH, r6("volume_score"), r6("lag_score"), r6("violation_score"))


@query
def anomaly_score(spark, d):
    return all_signals(spark, d).select(
        *BATCH,
        r6("volume_contribution"),
        r6("lag_contribution"),
        r6("violation_contribution"),
        r6("anomaly_score"),
        "anomaly_active",
        "anomaly_detected_at",
    )


@query
def anomaly_details(spark, d):
    return all_signals(spark, d).select(*BATCH, joined("anomaly_details", ";").alias("details"))


def fired(spark, d, with_reset: bool = False):
    rows = all_signals(spark, d)
    return al.alerts(rows, DAYS, stage(resets(spark, d)) if with_reset else None, span=span_of(rows))


def one_rule(spark, d, rule: str):
    return fired(spark, d).filter(F.col("rule") == rule).select(*BATCH, "level", "streak", "runbook_key")


@query
def alert_stall(spark, d):
    return one_rule(spark, d, "stall")


@query
def alert_null_rate(spark, d):
    return one_rule(spark, d, "null_rate")


@query
def alert_schema(spark, d):
    return one_rule(spark, d, "schema")


@query
def alert_lag(spark, d):
    return one_rule(spark, d, "lag")


@query
def alert_anomaly(spark, d):
    return one_rule(spark, d, "anomaly")


@query
def alert_halt(spark, d):
    rows = outcomes(spark, d)
    rows = al.halt_alert_rows(rows, stage(resets(spark, d)), span=span_of(rows))
    return rows.select(*BATCH, "level", "runbook_key")


@query
def alert_with_reset(spark, d):
    return fired(spark, d, with_reset=True).select(*BATCH, "rule", "level", "streak", "runbook_key")


@query
def alerts_fired(spark, d):
    rows = all_signals(spark, d)
    everything = al.all_alerts(rows, DAYS, stage(resets(spark, d)), span=span_of(rows))
    return al.fired_levels(everything).withColumn("levels", joined("levels", ";"))


@query
def alert_runbook(spark, d):
    # One key is left out of the table to show the fallback.
    texts = {k: v for k, v in al.RUNBOOKS.items() if k != "high_lag"}
    rows = al.with_runbook(fired(spark, d), al.runbook_table(spark, texts))
    return rows.select(*BATCH, "rule", "runbook_key", "runbook")


# ---- history and metrics ---------------------------------------------------


def stored(spark, d):
    return hi.history_rows(all_signals(spark, d))


def in_ms(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"started_at": F.unix_millis("started_at"), "completed_at": F.unix_millis("completed_at")}
    ).drop("started_date")


@query
def batch_outcomes(spark, d):
    return in_ms(stored(spark, d))


@query
def history_idempotent_append(spark, d):
    # Two thirds are stored already; every batch arrives twice.
    rows = stage(stored(spark, d))
    already = rows.filter("batch_id % 3 <> 0")
    # The second time a batch comes a day later; a stored one must stay as it is.
    later = rows.withColumns(
        {c: F.col(c) + F.expr("INTERVAL 1 DAY") for c in ("started_at", "completed_at")}
    ).withColumn("started_date", F.date_add("started_date", 1))
    fresh = hi.new_rows(rows.unionByName(later), already)
    return in_ms(already.unionByName(fresh))


@query
def recent_stats(spark, d):
    return hi.recent_stats(stage(stored(spark, d)), minutes=7 * 24 * 60)


@query
def outcome_history(spark, d):
    rows = hi.by_outcome(stored(spark, d), "quarantine", since="2024-01-08")
    return in_ms(rows).select(*BATCH, "outcome", "total_records", "quarantined", "started_at")


@query
def quality_by_weekday(spark, d):
    return hi.quality_by_weekday(stored(spark, d)).withColumn("quality", F.round("quality", 6))


@query
def metric_records_total(spark, d):
    return me.counters(outcomes(spark, d))


@query
def metric_histograms(spark, d):
    return me.histograms(all_signals(spark, d))


@query
def metric_gauges_latest(spark, d):
    return me.latest_gauges(all_signals(spark, d), DAYS).withColumn("value", F.round("value", 6))


@query
def metric_rollout(spark, d):
    lag = it.consumer_lag(*fx.source_offsets(spark, d))
    return me.rollout_counts(keyed_clean(spark, d), lag, DAYS.but(throttle_on_lag=1000))


@query
def dash_records_rate(spark, d):
    return me.records_rate(all_signals(spark, d)).withColumn("per_second", F.round("per_second", 6))


@query
def dash_threshold_series(spark, d):
    return me.threshold_series(all_signals(spark, d), DAYS).withColumn("value", F.round("value", 6))


@query
def dash_quality_series(spark, d):
    return me.quality_series(all_signals(spark, d)).withColumn("value", F.round("value", 6))


@query
def dash_latency_buckets(spark, d):
    return me.latency_bucket_rates(all_signals(spark, d)).withColumn("per_second", F.round("per_second", 6))
