"""Idempotency keys and hash samples as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: keys keep this many hex digits of the SHA-256.
KEY_LENGTH = 32


def hashed(parts: Sequence[Column]) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, KEY_LENGTH)


def shown(value: Column) -> Column:
    """Text of a key part; a null reads `None`, as the key format has it."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def clean_key(columns: Sequence[str], topic: str, key_fields: Sequence[str], own: Sequence[str]) -> Column:
    """Key of a clean record: event id, topic, then the other key fields.

    `own` names the envelope fields; a key field outside the envelope (such as
    a batch id) gives an empty part.
    """
    rest = [shown(F.col(f)) if f in own and f in columns else F.lit("") for f in key_fields if f != "event_id"]
    return hashed([shown(F.col("event_id")), F.lit(topic), *rest])


def dead_letter_key(batch_id: Column, violations: Column, place: Column | None = None) -> Column:
    """Key of a dead letter: event id, batch, and its sorted reasons.

    A record without an event id goes by its `place`, so that the undecodable
    records of a batch do not share one key.
    """
    reasons = F.array_join(F.sort_array(violations), ".")
    named = shown(F.col("event_id"))
    if place is not None:
        named = F.when(F.col("event_id").isNull(), place).otherwise(named)
    return hashed([named, shown(batch_id), F.lit("dlq"), reasons])


def place_of(columns: Sequence[str]) -> Column:
    """Where a record came from, and a hash of what it held."""
    known = ["topic", "partition", "offset"]
    if not all(c in columns for c in known):
        known = [c for c in ("feed", "seq") if c in columns]
    held = [F.col(c) for c in ("raw_value", "payload_json") if c in columns]
    content = F.sha2(F.concat_ws("", *held), 256)
    return F.concat_ws("/", *[shown(F.col(c)) for c in known], content)


def hash_share(key: Column) -> Column:
    """The key's place in [0, 1) in steps of one hundredth."""
    number = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")
    return (number % 100).cast("double") / F.lit(100.0)
