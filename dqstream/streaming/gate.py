"""One micro-batch after another through checks, breaker, routes and history.

State between micro-batches is a few small tables, written per epoch: the last
signals row of each feed, the lag samples and the folded volumes still in view,
and the keys accepted within the dedup window. An epoch reads what earlier
epochs wrote and overwrites its own output, so an epoch that runs again after
a failure gives the same result, and a restart goes on where it stopped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.query import StreamingQuery

from dqstream.contract import HALT
from dqstream.operators import alerts as al
from dqstream.operators import dedup as de
from dqstream.operators import history as hi
from dqstream.operators import routing as ro
from dqstream.operators.batches import fill_empty, offset_context
from dqstream.operators.lag import lag_tails, split_late
from dqstream.operators.signals import batch_facts, combine
from dqstream.operators.validate import validate_events
from dqstream.operators.volume import volume_grid
from dqstream.plans.scan import SPAN
from dqstream.plans.stage import remove, stage, staging
from dqstream.policy import Policy
from dqstream.session import configure


# Marks rows that only say the time.
HEARTBEAT = "heartbeat"
# Keys accepted per window-long slot and epoch.
_ACCEPTED = "idempotency_key string, received_at bigint, slot bigint, epoch bigint"


class HaltedError(RuntimeError):
    """The breaker halted a batch; add a reset, to retry or to release it, and start again."""


@dataclass
class Gate:
    """Processes epochs under `root`; use `run_stream` to start it.

    `resets` is a folder of (feed, batch_id) rows with an optional `action`. With
    `stop_on_halt` a halted batch ends the query before its offsets are committed.
    History, alerts and all other batches of the epoch are written first, and the
    row of the first halt is kept in `halts`. After a reset the epoch runs again:
    the breaker is closed before the batch, and if it halts by itself, a reset
    with action `release` sends its events to `halted` and lets the stream go on.
    Without `stop_on_halt` that is what happens to every halted batch.

    Accepted keys are dropped once they are older than the dedup window and
    `skew_seconds` before the newest record, which is how far one partition may
    lag behind another.
    """

    policy: Policy
    root: str
    resets: str | None = None
    stop_on_halt: bool = True
    feed: str = "main"
    skew_seconds: int = 86_400

    def __call__(self, df: DataFrame, epoch: int) -> None:
        p, spark = self.policy, df.sparkSession
        events = df if "feed" in df.columns else df.withColumn("feed", F.lit(self.feed))
        beats = None
        if HEARTBEAT in events.columns:
            if "batch_id" in events.columns:
                raise ValueError("heartbeats need batches that are numbered by epoch")
            told = events.filter(HEARTBEAT).groupBy(F.coalesce("feed", F.lit(self.feed)).alias("feed"))
            beats = told.agg(F.max("received_at").alias("beat"))
            events = events.filter(f"NOT {HEARTBEAT}").drop(HEARTBEAT)
        if "batch_id" not in events.columns:
            events = events.withColumn("batch_id", F.lit(epoch).cast("bigint"))
        checked = validate_events(events, p).persist()
        try:
            with staging(spark):
                self._epoch(spark, checked, epoch, beats)
        finally:
            checked.unpersist()

    def _epoch(self, spark: SparkSession, checked: DataFrame, epoch: int, beats: DataFrame | None = None) -> None:
        p = self.policy
        facts = stage(batch_facts(checked, p))
        if beats is not None:
            facts = stage(facts.unionByName(silent_batches(facts, beats, epoch)))
        batches, feeds = facts.agg(F.count(F.lit(1)), F.count_distinct("feed")).first()
        if batches == 0:
            return
        state = self._last(spark, "state", epoch)
        tails = self._also(stage(lag_tails(checked, p, counts=facts)), self._last(spark, "tails", epoch))
        grid = self._also(stage(volume_grid(checked)), self._last(spark, "ledger", epoch))
        resets = self._new_resets(spark, state)
        span = None if batches <= SPAN else SPAN
        rows = combine(facts, tails, grid, p, resets, state, span, one_batch=batches == feeds)
        if span is not None:
            rows = stage(rows)
        counted = al.alert_streaks(rows, p, resets, state, span)
        judged = stage(al.halt_alerts(counted, initial=state, span=span))

        fired = al.fired(judged, p).unionByName(al.fired_halts(judged))
        self._write(al.with_runbook(fired, al.runbook_table(spark)), "alerts", epoch)
        self._write_history(hi.history_rows(judged), epoch)
        # One row per batch with every signal: what metrics and panels are made of.
        self._write(judged, "signals", epoch)
        self._context(checked, epoch)
        routes = self._route(spark, checked, judged, epoch)
        if p.routes:
            halted = judged.filter(F.col("outcome") == HALT)
            held = ro.held_back(judged, resets) if self.stop_on_halt else halted.limit(0)
            first = held.agg(F.min("batch_id")).first()[0]
            if first is not None:
                hi.history_rows(halted).write.mode("ignore").parquet(self._path("halts", epoch))
                raise HaltedError(f"batch {first} halted; a reset must retry or release it")
            if not self.stop_on_halt or resets is not None:
                self._write(routes.halted.drop("is_valid"), "halted", epoch)

        self._write(self._last_rows(state, judged), "state", epoch)
        self._write(self._live_tails(tails), "tails", epoch)
        self._write(self._live_grid(grid, judged), "ledger", epoch)
        self._forget(spark, epoch)

    def _context(self, checked: DataFrame, epoch: int) -> None:
        """Offsets of each batch, where the source has them, and late events by event date."""
        if all(c in checked.columns for c in ("topic", "partition", "offset")):
            self._write(offset_context(checked), "offsets", epoch)
        late = split_late(checked.select("feed", "batch_id", "seq", "event_id", "occurred_at", "received_at"), self.policy)[1]
        self._write(late, "late", epoch)

    # -- sinks --------------------------------------------------------------

    def _route(self, spark: SparkSession, checked: DataFrame, judged: DataFrame, epoch: int) -> ro.Routes:
        p = self.policy
        routes = ro.route(checked, judged, p)
        if not p.routes:
            return routes
        clean = self._once(spark, ro.with_idempotency_key(routes.clean, p), "clean", epoch)
        dead = self._once(spark, ro.with_dlq_key(routes.dead), "dead", epoch)
        self._write(ro.sink_rows(clean, p.clean_topic), "clean", epoch)
        self._write(ro.dlq_sink_rows(dead, p.error_topic), "dead", epoch)
        if p.shadow_percentage > 0:
            self._write(ro.sink_rows(ro.shadow_sample(clean, p), p.shadow_topic), "shadow", epoch)
        return routes

    def _once(self, spark: SparkSession, keyed: DataFrame, route: str, epoch: int) -> DataFrame:
        """Leave out keys accepted within the window, here or in earlier epochs."""
        p = self.policy
        if not p.dedup_enabled:
            return keyed
        gap = p.dedup_window_seconds * 1000
        where = f"accepted_{route}"
        seen = None
        if self._exists(spark, where):
            # Slots are as long as the window, so the bound prunes folders.
            oldest, newest = keyed.agg(F.min("received_at"), F.max("received_at")).first()
            if oldest is not None:
                self._forget_slots(spark, where, (newest - gap - self.skew_seconds * 1000) // gap)
                stored = spark.read.schema(_ACCEPTED).parquet(self._path(where)).filter(
                    (F.col("slot") >= (oldest - gap) // gap)
                    & (F.col("received_at") >= oldest - gap)
                    & (F.col("epoch") < epoch)
                )
                seen = stored.groupBy("idempotency_key").agg(F.max("received_at").alias("received_at"))
        kept = de.dedup_window(keyed, "idempotency_key", "received_at", ["feed", "seq"], p.dedup_window_seconds, seen)
        marks = kept.select(
            "idempotency_key",
            "received_at",
            F.expr(f"received_at div {gap}L").alias("slot"),
            F.lit(epoch).cast("bigint").alias("epoch"),
        )
        # A second run of the epoch may accept other keys than the first.
        for slot in self._folders(spark, where, "slot"):
            remove(spark, f"{self._path(where)}/slot={slot}/epoch={epoch}")
        self._replace(marks, where, ["slot", "epoch"])
        return kept

    # -- state --------------------------------------------------------------

    def _last_rows(self, state: DataFrame | None, judged: DataFrame) -> DataFrame:
        """The newest row of each feed; feeds without new batches keep theirs."""
        pool = judged if state is None else judged.unionByName(state.select(*judged.columns))
        newest = W.partitionBy("feed").orderBy(F.desc("batch_id"))
        return pool.withColumn("__rn", F.row_number().over(newest)).filter("__rn = 1").drop("__rn")

    def _live_tails(self, tails: DataFrame) -> DataFrame:
        """Newest batches of each feed that together hold a full sample."""
        after = W.partitionBy("feed").orderBy(F.desc("batch_id")).rowsBetween(W.unboundedPreceding, -1)
        newer = F.coalesce(F.sum("event_count").over(after), F.lit(0))
        return tails.withColumn("__newer", newer).filter(F.col("__newer") < self.policy.lag_samples).drop("__newer")

    def _live_grid(self, grid: DataFrame, judged: DataFrame) -> DataFrame:
        """Folded volumes that a later clock can still count."""
        reach = max(self.policy.baseline_window_seconds, 2 * self.policy.short_window_seconds) * 1000
        clock = judged.groupBy("feed").agg(F.max("clock").alias("__clock"))
        live = grid.join(clock, "feed", "left").filter(
            F.col("__clock").isNull() | (F.col("occurred_at") >= F.col("__clock") - reach)
        )
        return live.drop("__clock")

    def _new_resets(self, spark: SparkSession, state: DataFrame | None) -> DataFrame | None:
        """Resets that come after the last batch of their feed."""
        if self.resets is None or not self._exists(spark, None, self.resets):
            return None
        rows = spark.read.parquet(self.resets)
        action = F.col("action") if "action" in rows.columns else F.lit("retry")
        rows = rows.select("feed", "batch_id", action.alias("action"))
        if state is not None:
            done = state.select("feed", F.col("batch_id").alias("__done"))
            rows = rows.join(done, "feed", "left").filter(F.col("__done").isNull() | (F.col("batch_id") > F.col("__done")))
        return stage(rows.select("feed", "batch_id", "action").distinct())

    # -- tables -------------------------------------------------------------

    def _path(self, name: str, epoch: int | None = None) -> str:
        return f"{self.root}/{name}" if epoch is None else f"{self.root}/{name}/epoch={epoch}"

    def _write(self, df: DataFrame, name: str, epoch: int) -> None:
        df.write.mode("overwrite").parquet(self._path(name, epoch))

    def _replace(self, df: DataFrame, name: str, by: list[str]) -> None:
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*by).parquet(self._path(name))

    def _write_history(self, rows: DataFrame, epoch: int) -> None:
        """One write per epoch, in folders of its own per start date."""
        self._replace(rows.withColumn("epoch", F.lit(epoch).cast("bigint")), "history", ["started_date", "epoch"])

    def _exists(self, spark: SparkSession, name: str | None, path: str | None = None) -> bool:
        where = spark._jvm.org.apache.hadoop.fs.Path(path or self._path(name))
        return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)

    def _last(self, spark: SparkSession, name: str, epoch: int) -> DataFrame | None:
        """What the latest earlier epoch wrote; epochs without events write nothing."""
        earlier = [e for e in self._epochs(spark, "ledger") if e < epoch and self._complete(spark, e)]
        return spark.read.parquet(self._path(name, max(earlier))) if earlier else None

    def _epochs(self, spark: SparkSession, name: str) -> list[int]:
        return self._folders(spark, name, "epoch")

    def _folders(self, spark: SparkSession, name: str, key: str) -> list[int]:
        """Values of the partition folders `key=...` of a table."""
        if not self._exists(spark, name):
            return []
        path = spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        names = [s.getPath().getName() for s in listed]
        return [int(n.split("=")[1]) for n in names if n.startswith(f"{key}=")]

    def _forget_slots(self, spark: SparkSession, name: str, first: int) -> None:
        """Drop accepted keys out of reach; one more window is kept for an epoch that runs again."""
        for slot in self._folders(spark, name, "slot"):
            if slot < first - 1:
                remove(spark, f"{self._path(name)}/slot={slot}")

    def _complete(self, spark: SparkSession, epoch: int) -> bool:
        """The ledger is written last; with it an epoch's state is whole."""
        return self._exists(spark, None, self._path("ledger", epoch) + "/_SUCCESS")

    def _forget(self, spark: SparkSession, epoch: int) -> None:
        """Drop state that no epoch will read again; the one before may run once more."""
        kept = max((e for e in self._epochs(spark, "ledger") if e < epoch), default=epoch)
        for name in ("ledger", "tails", "state"):
            for old in self._epochs(spark, name):
                if old < kept:
                    remove(spark, self._path(name, old))

    @staticmethod
    def _also(new: DataFrame, old: DataFrame | None) -> DataFrame:
        return new if old is None else new.unionByName(old.select(*new.columns))


def silent_batches(facts: DataFrame, beats: DataFrame, epoch: int) -> DataFrame:
    """An empty batch, at the time of its newest heartbeat, for each feed without events in the epoch."""
    quiet = beats.join(facts.select("feed"), "feed", "left_anti")
    empty = fill_empty(facts, quiet.select("feed", F.lit(epoch).cast("bigint").alias("batch_id"), "beat"))
    return empty.withColumns({"started_at": F.col("beat"), "completed_at": F.col("beat")}).select(*facts.columns)


def with_heartbeats(events: DataFrame, feed: str, every_seconds: int = 1) -> DataFrame:
    """The stream with a row per `every_seconds` that says the time, so that silence is judged too.

    Such rows are no events: they advance the clock of a feed without events, so
    that its windows run empty and, with `flag_outage`, a stall is raised.
    """
    spark = events.sparkSession
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load().filter(f"value % {every_seconds} = 0")
    told = {"feed": F.lit(feed), "received_at": F.unix_millis("timestamp"), HEARTBEAT: F.lit(True)}
    named = events.drop("feed").withColumns({"feed": F.lit(feed), HEARTBEAT: F.lit(False)})
    beats = [told.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in named.schema.fields]
    return named.unionByName(ticks.select(*beats))


def run_stream(
    events: DataFrame,
    p: Policy,
    root: str,
    resets: str | None = None,
    stop_on_halt: bool = True,
    available_now: bool = False,
) -> StreamingQuery:
    """Start the gate on a stream of events.

    Offsets are committed by the checkpoint when an epoch is through. With
    `available_now` the query ends when the source has been read.
    """
    configure(events.sparkSession)
    writer = events.writeStream.foreachBatch(Gate(p, root, resets, stop_on_halt)).option(
        "checkpointLocation", f"{root}/checkpoint"
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{p.batch_timeout_ms} milliseconds"}
    return writer.trigger(**trigger).start()
