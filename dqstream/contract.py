"""The envelope contract, reason codes and outcomes."""

from __future__ import annotations

from pyspark.sql import types as T

# The nine envelope fields. The first seven are required.
ENVELOPE = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_version", T.IntegerType()),
        T.StructField("producer", T.StringType()),
        T.StructField("occurred_at", T.LongType()),
        T.StructField("partition_key", T.StringType()),
        T.StructField("payload_json", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    ]
)
REQUIRED_ENVELOPE = [
    "event_id",
    "event_type",
    "event_version",
    "producer",
    "occurred_at",
    "partition_key",
    "payload_json",
]

# The same contract in Avro's JSON form, for binary Avro sources.
ENVELOPE_AVRO = """
{"type": "record", "name": "Envelope", "namespace": "dqstream", "fields": [
  {"name": "event_id", "type": "string"},
  {"name": "event_type", "type": "string"},
  {"name": "event_version", "type": "int"},
  {"name": "producer", "type": "string"},
  {"name": "occurred_at", "type": {"type": "long", "logicalType": "timestamp-millis"}},
  {"name": "partition_key", "type": "string"},
  {"name": "payload_json", "type": "string"},
  {"name": "trace_id", "type": ["null", "string"], "default": null},
  {"name": "headers", "type": ["null", {"type": "map", "values": "string"}], "default": null}
]}
"""

# Reason codes that can be put on an event.
SCHEMA_VIOLATION = "schema_violation"
MISSING_FIELD = "missing_required_field"
INVALID_VALUE = "invalid_field_value"

# Batch outcomes.
PASS = "pass"
QUARANTINE = "quarantine"
HALT = "halt"

# Columns that identify a batch. `feed` names the stream, `batch_id` is an
# ordinal that grows in processing order.
BATCH = ["feed", "batch_id"]
