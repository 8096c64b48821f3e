"""What a running stream tells about itself, as tables.

A listener writes one row per finished micro-batch: rows read, offsets, durations
and rows dropped by the watermark. Lag, backpressure and latency of the running
stream come from that table by the operators that serve offset tables.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from dqstream.operators.intake import backpressure_flag, consumer_lag
from dqstream.policy import Policy

PROGRESS = (
    "query string, run string, epoch bigint, finished_at timestamp, input_rows bigint, dropped_rows bigint, "
    "state_rows bigint, trigger_ms bigint, add_batch_ms bigint, "
    "offsets array<struct<topic:string,partition:int,committed:bigint,high:bigint>>"
)


class ProgressTable(StreamingQueryListener):
    """Writes the progress of the queries with a name to `path`, a folder per query, run and epoch.

    An epoch that is reported again, or by a later run, has a folder of its own or
    replaces its own; `read_progress` takes the newest of an epoch.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path = spark, path

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        told = json.loads(event.progress.json)
        if not told.get("name"):
            return
        operators, spent = told.get("stateOperators", []), told.get("durationMs", {})
        row = {
            "query": told["name"],
            "run": told["runId"],
            "epoch": told["batchId"],
            "finished_at": told["timestamp"],
            "input_rows": told.get("numInputRows", 0),
            "dropped_rows": sum(o.get("numRowsDroppedByWatermark", 0) for o in operators),
            "state_rows": sum(o.get("numRowsTotal", 0) for o in operators),
            "trigger_ms": spent.get("triggerExecution", 0),
            "add_batch_ms": spent.get("addBatch", 0),
            "offsets": [o for s in told.get("sources", []) for o in offsets_of(s)],
        }
        line = self._spark.createDataFrame([(json.dumps(row),)], "line string")
        where = f"{self._path}/query={row['query']}/run={row['run']}/epoch={row['epoch']}"
        line.select(F.from_json("line", PROGRESS).alias("r")).select("r.*").drop("query", "run", "epoch").coalesce(1).write.mode(
            "overwrite"
        ).json(where)


def offsets_of(source: dict) -> list[dict]:
    """Committed and newest offset per topic partition, where the source has any."""
    committed, high = (_offsets(source.get(k)) for k in ("endOffset", "latestOffset"))
    places = sorted({*committed, *high})
    return [
        {"topic": t, "partition": n, "committed": committed.get((t, n)), "high": high.get((t, n), committed.get((t, n)))}
        for t, n in places
    ]


def _offsets(told: Any) -> dict[tuple[str, int], int]:
    """{(topic, partition): offset} of a topic source; other sources have other offsets."""
    held = json.loads(told) if isinstance(told, str) else told
    if not isinstance(held, dict):
        return {}
    topics = {t: ps for t, ps in held.items() if isinstance(ps, dict)}
    return {(t, int(n)): int(o) for t, ps in topics.items() for n, o in ps.items()}


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """One row per query and epoch; the report that came last stands."""
    rows = spark.read.schema(PROGRESS).json(path)
    newest = F.max_by(F.struct(*[c for c in rows.columns if c not in ("query", "epoch")]), "finished_at").alias("r")
    return rows.groupBy("query", "epoch").agg(newest).select("query", "epoch", "r.*")


def live_lag(progress: DataFrame, p: Policy, landed: DataFrame | None = None) -> DataFrame:
    """Records behind and the backpressure flag, per topic of each query's newest epoch.

    A topic source tells its offsets. A folder has none: `landed` holds its rows, of
    which those read so far are taken off; its topic is the query's name.
    """
    if landed is None:
        newest = progress.groupBy("query").agg(F.max_by("offsets", "epoch").alias("offsets"))
        places = newest.select(F.inline("offsets"))
    else:
        read = progress.groupBy("query").agg(F.sum("input_rows").alias("committed"))
        total = landed.agg(F.count(F.lit(1)).alias("high"))
        places = read.join(total).select(F.col("query").alias("topic"), F.lit(0).alias("partition"), "committed", "high")
    committed = places.where("committed IS NOT NULL").select("topic", "partition", "committed")
    return backpressure_flag(consumer_lag(committed, places.select("topic", "partition", "high")), p)


def live_latency(progress: DataFrame) -> DataFrame:
    """Milliseconds and rows a second of each micro-batch with rows."""
    rate = F.expr("input_rows * 1000 / nullif(trigger_ms, 0)")
    return progress.where("input_rows > 0").select(
        "query", "epoch", "input_rows", F.col("trigger_ms").alias("latency_ms"), rate.alias("rows_per_second")
    )
