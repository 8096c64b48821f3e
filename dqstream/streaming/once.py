"""Window dedup as keyed stream state, with timers for order and eviction.

The same rows as `dedup_window` gives on the whole table, whatever epochs the
records come in: a record waits in the state of its key until the watermark has
passed its time, so that records of a partition that lags behind still take their
place, and is judged then, in order of time. The last acceptance of a key stays
until a timer finds that no later record can fall within its window. State lives
in the RocksDB store, is committed with the epoch, and moves with its partition.

A record that comes `skew_seconds` or more behind newer ones is no longer judged:
the engine leaves it out and counts it as dropped by the watermark. Records
without a key or a time are passed on at once, as they can repeat nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The store that keeps state on disk and supports several state variables per key.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}
_KEY, _TIME, _AT = "__key", "__time", "__at"


class AcceptOnce(StatefulProcessor):
    """Per key: the records that wait for the watermark, and the last accepted time."""

    def __init__(self, columns: Sequence[str], order: Sequence[str], gap_ms: int, waiting: T.StructType) -> None:
        self._columns, self._order, self._gap, self._waiting = list(columns), list(order), gap_ms, waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getListState("held", self._waiting)
        self._last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [tuple(r[c] for c in [_TIME, *self._columns]) for r in rows]
        self._held.appendList(new)
        # The earliest record that waits has the timer; a later one is set when it fires.
        self._handle.registerTimer(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self._held.get()] if self._held.exists() else []
        at = [1 + self._columns.index(c) for c in self._order]
        due = sorted((r for r in held if r[0] <= now), key=lambda r: (r[0], *(r[i] for i in at)))
        later = [r for r in held if r[0] > now]
        last = self._last.get()[0] if self._last.exists() else None
        accepted = []
        for r in due:
            if last is None or r[0] - last > self._gap:
                last = r[0]
                accepted.append(Row(**dict(zip(self._columns, r[1:]))))
        if due:
            if later:
                self._held.put(later)
            else:
                self._held.clear()
        if later:
            self._handle.registerTimer(min(r[0] for r in later))
        if last is not None:
            if last + self._gap < now and not later:
                self._last.clear()
            else:
                if accepted:
                    self._last.update((last,))
                self._handle.registerTimer(max(last + self._gap, now) + 1)
        yield from accepted

    def close(self) -> None:
        pass


def accept_once(
    events: DataFrame, key: str, time: str, order: Sequence[str], seconds: int, skew_seconds: int
) -> DataFrame:
    """The records of a stream that `dedup_window` accepts; `time` is epoch milliseconds.

    Its session needs `STORE`. `order` parts records of one key and time.
    """
    columns = events.columns
    marked = events.withColumn(_KEY, F.col(key).cast("string")).withColumn(_TIME, F.col(time).cast("bigint"))
    stamped = marked.withColumn(_AT, F.timestamp_millis(_TIME)).withWatermark(_AT, f"{skew_seconds} seconds")
    keyed = stamped.where(f"{_KEY} IS NOT NULL AND {_TIME} IS NOT NULL")
    waiting = T.StructType([T.StructField(_TIME, T.LongType()), *events.schema.fields])
    judged = keyed.groupBy(_KEY).transformWithState(
        AcceptOnce(columns, order, seconds * 1000, waiting), events.schema, "Append", "EventTime"
    )
    unkeyed = stamped.where(f"{_KEY} IS NULL OR {_TIME} IS NULL").select(*columns)
    return judged.select(*columns).unionByName(unkeyed)
