"""Routing to clean output, dead letters and shadow copy; replay."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqstream.contract import BATCH, ENVELOPE, HALT, SCHEMA_VIOLATION
from dqstream.functions import keys
from dqstream.operators.dedup import first_seen
from dqstream.operators.validate import encode_envelopes, payload_violations
from dqstream.policy import Policy


class Routes(NamedTuple):
    clean: DataFrame
    dead: DataFrame
    halted: DataFrame


def route(validated: DataFrame, outcomes: DataFrame, p: Policy) -> Routes:
    """Split events: valid, invalid, and those of halted batches.

    Routing is per event, so valid events of a quarantined batch stay clean.
    Only the ids of halted batches are joined; a dry run routes nothing.
    """
    if not p.routes:
        none = validated.filter(F.lit(False))
        return Routes(none, none, none)
    stopped = outcomes.filter(F.col("outcome") == HALT).select(*BATCH)
    return Routes(
        validated.filter("is_valid").join(stopped, BATCH, "left_anti"),
        validated.filter("NOT is_valid").join(stopped, BATCH, "left_anti"),
        validated.join(stopped, BATCH, "left_semi"),
    )


def _letter(columns: list[str]) -> dict[str, Column]:
    """The eight fields of a dead letter."""
    trace, detail, original = F.col("trace_id"), F.lit(""), F.col("payload_json")
    if "raw_value" in columns:
        detail = F.when(F.col("raw_value").isNotNull(), "envelope cannot be decoded").otherwise(detail)
        original = F.coalesce(original, F.col("raw_value"))
    if "record_trace_id" in columns:
        trace = F.coalesce(F.col("record_trace_id"), trace)
    if "error_detail" in columns:
        detail = F.coalesce(F.col("error_detail"), detail)
    return {
        "event_id": F.col("event_id"),
        "event_type": F.col("event_type"),
        "reason_codes": F.col("violations"),
        "quarantined_at": F.col("received_at"),
        "batch_id": F.col("batch_id"),
        "trace_id": trace,
        "error_detail": detail,
        "original_payload_json": original,
    }


def dlq_records(dead: DataFrame) -> DataFrame:
    """Dead letters as a table; the receive time stands for the quarantine time."""
    return dead.select(*[c.alias(n) for n, c in _letter(dead.columns).items()])


def dlq_reason_counts(dead: DataFrame) -> DataFrame:
    """Dead letters per reason, every occurrence counted, before dedup."""
    return (
        dead.select(F.explode("violations").alias("reason_code")).groupBy("reason_code").agg(
            F.count(F.lit(1)).alias("records")
        )
    )


def with_idempotency_key(df: DataFrame, p: Policy) -> DataFrame:
    key = keys.clean_key(df.columns, p.clean_topic, p.key_fields, ENVELOPE.fieldNames())
    return df.withColumn("idempotency_key", key)


def with_dlq_key(df: DataFrame) -> DataFrame:
    key = keys.dead_letter_key(F.col("batch_id"), F.col("violations"), keys.place_of(df.columns))
    return df.withColumn("idempotency_key", key)


def shadow_sample(keyed: DataFrame, p: Policy) -> DataFrame:
    """Clean records whose key hash falls in the shadow share."""
    if p.shadow_percentage <= 0:
        return keyed.filter(F.lit(False))
    return keyed.filter(keys.hash_share(F.col("idempotency_key")) < F.lit(float(p.shadow_percentage)))


def sink_rows(keyed: DataFrame, topic: str, value: Column | None = None) -> DataFrame:
    """Rows for a keyed sink: topic, key, value and the key header."""
    with_value = encode_envelopes(keyed) if value is None else keyed.withColumn("value", value)
    header = F.struct(
        F.lit("idempotency_key").alias("key"), F.col("idempotency_key").cast("binary").alias("value")
    )
    return with_value.select(
        F.lit(topic).alias("topic"),
        F.col("partition_key").alias("key"),
        "value",
        F.array(header).alias("headers"),
    )


def dlq_sink_rows(keyed: DataFrame, topic: str) -> DataFrame:
    """Dead letters as rows for a keyed sink."""
    body = F.to_json(F.struct(*[c.alias(n) for n, c in _letter(keyed.columns).items()]))
    return sink_rows(keyed, topic, body)


def held_back(outcomes: DataFrame, resets: DataFrame | None) -> DataFrame:
    """Halted batches that no reset releases; they keep a stream from going on.

    A reset with action `release` gives a halted batch up: its events go to the
    halted output. Any other reset asks for the batch to be judged again.
    """
    halted = outcomes.filter(F.col("outcome") == HALT).select(*BATCH)
    if resets is None or "action" not in resets.columns:
        return halted
    return halted.join(resets.filter("action = 'release'").select(*BATCH), BATCH, "left_anti")


def dry_run_report(outcomes: DataFrame) -> DataFrame:
    """What routing would do, per batch."""
    return outcomes.select(*BATCH, "outcome", "total_records", "passed", "quarantined")


def replay(letters: DataFrame, p: Policy) -> DataFrame:
    """Check dead letters again under a new policy, once per event.

    A structural failure cannot be mended from the payload and is left out.
    """
    usable = letters.filter(~F.array_contains("reason_codes", SCHEMA_VIOLATION))
    once = first_seen(usable, ["event_id"], ["quarantined_at", "batch_id"])
    checked = payload_violations(once.withColumnRenamed("original_payload_json", "payload_json"), p)
    return checked.withColumn("recovered", F.size("violations") == 0)
