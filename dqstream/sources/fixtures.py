"""Test streams derived from the `events` table.

`events` holds clean rows only. The envelopes made from it carry planted
faults and lateness, and on request a volume drop, at places fixed by integer
arithmetic on the event id, so any engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqstream.contract import ENVELOPE
from dqstream.plans.scan import dense_rank_of_rows

# Fixed value: six hours in milliseconds.
SIX_HOURS_MS = 21_600_000


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One envelope per event, with planted faults; batches of 100 ids."""
    at = F.col("ts").cast("timestamp")
    ms = F.unix_millis(at)
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    eid = F.col("event_id")
    hundred = F.expr("event_id div 100")
    place = eid % 100
    usr = F.concat(F.lit("usr_"), F.col("user_id").cast("string"))

    def quoted(c):
        return F.concat(F.lit('"'), c, F.lit('"'))

    user_part = F.when(place == 21, F.lit("null")).otherwise(quoted(usr))
    time_part = (
        F.when(place == 55, F.lit('"yesterday"'))
        .when(place == 63, quoted(ms.cast("string")))
        .when(place == 71, ms.cast("string"))
        .otherwise(quoted(iso))
    )
    price_part = (
        F.when(place == 34, F.lit("-5"))
        .when(place == 42, F.lit('"free"'))
        .when(place == 77, F.lit("true"))
        .otherwise(F.col("value").cast("string"))
    )
    body = (
        F.when(place == 7, F.lit("not valid json"))
        .when(place == 81, F.lit("[]"))
        .when(
            place == 13,
            F.concat(
                F.lit('{"timestamp": '), quoted(iso), F.lit(', "price": '), F.col("value").cast("string"), F.lit("}")
            ),
        )
        .otherwise(
            F.concat(
                F.lit('{"user_id": '), user_part, F.lit(', "timestamp": '), time_part,
                F.lit(', "price": '), price_part, F.lit("}"),
            )
        )
    )
    no_type = (place == 89) | ((hundred % 20).isin(6, 7, 8) & (eid % 4 == 0))
    delay = (
        F.when((hundred % 12).isin(4, 5, 6, 7) & (eid % 5 == 0), F.lit(120_000))
        .when(eid % 17 == 0, F.lit(-500))
        .otherwise((eid * 37) % 5000)
    )
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(
        F.lit("main").alias("feed"),
        hundred.alias("batch_id"),
        eid.alias("seq"),
        F.concat(F.lit("evt-"), F.lpad(eid.cast("string"), 9, "0")).alias("event_id"),
        F.when(~no_type, F.col("event_type")).alias("event_type"),
        F.lit(1).alias("event_version"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 4).cast("string")).alias("producer"),
        ms.alias("occurred_at"),
        (ms + delay).alias("received_at"),
        usr.alias("partition_key"),
        body.alias("payload_json"),
        F.when(eid % 3 != 0, F.concat(F.lit("trace-"), eid.cast("string"))).alias("trace_id"),
        F.lit(None).cast("map<string,string>").alias("headers"),
    )


def thin_days(ms: Column) -> Column:
    """Whether a time lies in the volume drop, the 10th to 12th of the month."""
    return F.dayofmonth(F.timestamp_millis(ms)).between(10, 12)


def thinned(rows: DataFrame) -> DataFrame:
    """A volume drop: on its days one event of five stays, the others come three days earlier.

    Only for the queries whose feature it is: volumes, stalls and what is made of them.
    """
    early = F.when(thin_days(F.col("occurred_at")) & (F.col("seq") % 5 != 0), F.lit(259_200_000)).otherwise(F.lit(0))
    return rows.withColumns({c: F.col(c) - early for c in ("occurred_at", "received_at")})


def small_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelopes in batches of ten ids: passes, quarantines and halts mix."""
    return envelopes(spark, sf_dir).withColumn("batch_id", F.expr("seq div 10"))


def time_batches(spark: SparkSession, sf_dir: str, thin: bool = False) -> DataFrame:
    """The envelopes, or those with a volume drop, in batches of six hours of receive time."""
    rows = envelopes(spark, sf_dir)
    return (thinned(rows) if thin else rows).withColumn("batch_id", F.expr(f"received_at div {SIX_HOURS_MS}"))


def drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`user_id` renamed in two batches of ten, prices times 50 in one of ten."""
    tenth = F.col("batch_id") % 10
    renamed = F.replace(F.col("payload_json"), F.lit('"user_id"'), F.lit('"uuid"'))
    raised = F.regexp_replace("payload_json", r'"price": ([0-9.]+)\}', r'"price": $1e2}')
    return envelopes(spark, sf_dir).withColumn(
        "payload_json",
        F.when(tenth.isin(5, 6), renamed).when(tenth == 8, raised).otherwise(F.col("payload_json")),
    )


def widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices times ten and a tenth by turns in one batch of ten."""
    power = F.when(F.col("seq") % 2 == 0, r'"price": $1e1}').otherwise(r'"price": $1e-1}')
    spread = F.regexp_replace("payload_json", F.lit(r'"price": ([0-9.]+)\}'), power)
    return envelopes(spark, sf_dir).withColumn(
        "payload_json", F.when(F.col("batch_id") % 10 == 8, spread).otherwise(F.col("payload_json"))
    )


def replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelopes plus copies received 10 minutes and 2 hours later."""
    first = envelopes(spark, sf_dir)
    # One scan makes the row and its copies; `copy` tells them apart.
    shifts = F.array_compact(
        F.array(
            F.lit(0),
            F.when(F.col("seq") % 50 == 0, F.lit(600_000)),
            F.when(F.col("seq") % 75 == 0, F.lit(7_200_000)),
        )
    )
    return (
        first.withColumn("__shift", F.explode(shifts))
        .withColumn("received_at", F.col("received_at") + F.col("__shift"))
        .withColumn("copy", F.expr("__shift div 600000"))
        .drop("__shift")
    )


def transport_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelopes as transport rows: topic, partition, offset, key, value."""
    rows = envelopes(spark, sf_dir).withColumn(
        "partition", (F.substring("partition_key", 5, 20).cast("bigint") % 3).cast("int")
    )
    placed = dense_rank_of_rows(rows, ["partition"], "seq", "offset")
    whole = F.struct(*[F.col(f) for f in ENVELOPE.fieldNames()])
    return placed.select(
        "feed",
        "seq",
        F.lit("raw_events").alias("topic"),
        "partition",
        "offset",
        F.col("partition_key").alias("key"),
        F.when(F.col("seq") % 97 != 0, F.to_json(whole)).alias("value"),
        "received_at",
    )


def source_offsets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Committed and high-watermark offsets; partition 2 has no commit yet."""
    high = (
        transport_rows(spark, sf_dir)
        .groupBy("topic", "partition")
        .agg((F.max("offset") + 1).alias("high"))
    )
    committed = high.filter("partition <> 2").select(
        "topic", "partition", (F.col("high") - 10 * F.col("partition")).alias("committed")
    )
    return committed, high
