"""Event sources: transport topics and landing folders, batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqstream.contract import ENVELOPE
from dqstream.operators.intake import reading_limit
from dqstream.operators.validate import decode_envelopes, drop_tombstones
from dqstream.policy import Policy

# Fixed value: partitions a topic may have for offsets to give unique positions.
_MAX_PARTITIONS = 65_536

EVENTS = T.StructType(
    [
        T.StructField("feed", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        *[f for f in ENVELOPE.fields],
        T.StructField("received_at", T.LongType()),
    ]
)


def read_topic(
    spark: SparkSession, p: Policy, fmt: str = "json", streaming: bool = True, cap_batch: bool = False
) -> DataFrame:
    """Envelopes from the input topic, from the earliest offset.

    Needs the Kafka package on the classpath. A micro-batch takes what has come
    in since the last one; the policy's rate limit, or with `cap_batch` its
    batch size, bounds the records per trigger. Offsets are kept by the
    checkpoint, so nothing is committed before a batch is through.
    """
    reader = (spark.readStream if streaming else spark.read).format("kafka").options(**topic_options(p))
    limit = trigger_limit(p, cap_batch)
    if streaming and limit is not None:
        reader = reader.option("maxOffsetsPerTrigger", str(limit))
    return from_transport(reader.load(), fmt)


def topic_options(p: Policy) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": p.bootstrap_servers,
        "subscribe": p.input_topic,
        "startingOffsets": "earliest",
        "groupIdPrefix": p.consumer_group,
    }


def trigger_limit(p: Policy, cap_batch: bool) -> int | None:
    """The tighter of rate limit and, if asked for, batch size."""
    limits = [reading_limit(p), p.batch_size if cap_batch else None]
    return min((n for n in limits if n is not None), default=None)


def from_transport(raw: DataFrame, fmt: str = "json") -> DataFrame:
    """Transport rows as events: decoded, with position and receive time.

    Topic, partition and offset stay, for dead letters and the context of a batch.
    """
    position = F.when(
        F.col("partition") < _MAX_PARTITIONS, F.col("offset") * _MAX_PARTITIONS + F.col("partition")
    ).otherwise(F.raise_error(F.lit(f"partition numbers must be below {_MAX_PARTITIONS}")).cast("bigint"))
    placed = drop_tombstones(raw).select(
        F.col("topic").alias("feed"),
        "topic",
        "partition",
        "offset",
        position.alias("seq"),
        F.unix_millis("timestamp").alias("received_at"),
        "value",
    )
    return decode_envelopes(placed, "value", fmt)


def read_folder(
    spark: SparkSession,
    path: str,
    schema: T.StructType = EVENTS,
    fmt: str = "parquet",
    files_per_trigger: int | None = None,
    streaming: bool = True,
) -> DataFrame:
    """Events from files of a folder; as a stream, new files as they land."""
    if not streaming:
        return spark.read.schema(schema).format(fmt).load(path)
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.load(path)


def read_landing_avro(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes from Avro container files; needs the Avro package."""
    return spark.read.format("avro").load(path)
