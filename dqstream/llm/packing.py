"""Packing by non-negative least squares over shallow length combinations.

Documents are tokenised in place and cut into pieces of the window size and a
rest. Lengths are rounded up to units, so their histogram has a fixed number of
bins, and only that histogram reaches the driver. There, all combinations of at
most three lengths that fill the window exactly are enumerated, non-negative
least squares finds how often each should be used to meet the histogram, the
counts are rounded to what is there, and the rest is packed greedily, still as
counts per length. What would leave gaps even so, such as a length that a third
of all documents share, is laid end to end and cut where a window is full.

The plan is a table of rank ranges per length; each piece finds its sequence from
its rank among the pieces of its length. Ranks are counted per task as pieces are
made, and the counts of earlier tasks are added. Only pieces that are cut need
their ids again, which is why rests are kept with them.

Nulls: a null text has the end id only; a null doc_id is carried along. Repeated
rows are packed each on its own. An empty table gives no rows. Texts of any
length are cut whole; no column but doc_id and text is looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dqstream.llm.common import _arrow_schema, slim
from dqstream.llm.encoder import encoder
from dqstream.plans.stage import stage

WINDOW = 2048
UNIT = 8
END_ID = 1
DEPTH = 3


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Tokenise and cut: one row per piece, with its length in units, and its task and number there.

    `raw` holds the ids of pieces shorter than the window, two bytes each where
    `width` says so.
    """
    schema = (
        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "bin int, part int, nth bigint, width int, raw binary"
    )
    out = _arrow_schema(docs.sparkSession, schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        tail = np.array([end_id], "<u4").tobytes()
        made = [0] * (window // UNIT + 1)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                coded = enc.encode(text) + tail
                n = len(coded) // 4
                for start in range(0, n, window):
                    own = coded[start * 4 : (start + window) * 4]
                    size = len(own) // 4
                    units = -(-size // UNIT)
                    width, raw = _short(own) if size < window else (4, None)
                    rows.append((doc, start, size, zlib.crc32(own), n, units, part, made[units], width, raw))
                    made[units] += 1
            columns = list(zip(*rows)) if rows else [[]] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    texts = slim(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    return texts.mapInArrow(cut, schema)


def _short(coded: bytes) -> tuple[int, bytes]:
    ids = np.frombuffer(coded, "<u4")
    return (2, ids.astype("<u2").tobytes()) if int(ids.max()) < 1 << 16 else (4, coded)


def combinations(units: int) -> np.ndarray:
    """All ways to fill `units` with at most three lengths, as rows (a, b, c), 0 for none."""
    rows = [(units, 0, 0)]
    rows += [(units - b, b, 0) for b in range(1, units // 2 + 1)]
    rows += [(units - b - c, b, c) for c in range(1, units // 3 + 1) for b in range(c, (units - c) // 2 + 1)]
    return np.array(rows)


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float, steps: int = 4000) -> np.ndarray:
    """Least squares with x >= 0, by an active set: one column enters at a time.

    Ends when no column would gain more than `tolerance`.
    """
    x = np.zeros(a.shape[1])
    free: list[int] = []

    def fit() -> np.ndarray:
        own = a[:, free]
        return np.linalg.solve(own.T @ own + 1e-9 * np.eye(len(free)), own.T @ b)

    for _ in range(steps):
        gain = a.T @ (b - a @ x)
        gain[free] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= tolerance:
            break
        free.append(best)
        found = fit()
        while (low := found <= 0).any():
            # Go towards the fit until the first weight is used up, and let it leave.
            now = x[free]
            share = np.where(low, now / np.maximum(now - found, 1e-300), np.inf)
            now = now + share.min() * (found - now)
            now[share.argmin()] = 0
            x[:] = 0
            free = [f for f, v in zip(free, now) if v > 0]
            x[free] = now[now > 0]
            if not free:
                break
            found = fit()
        x[:] = 0
        if free:
            x[free] = found
    return x


@dataclass(frozen=True)
class Plan:
    """Rank ranges per length.

    Ranks from `first` on fill `each` slots from `slot` on in every sequence from
    `sequence` on; where `each` is 0 they lie end to end from unit `slot` on.
    """

    bin: np.ndarray
    first: np.ndarray
    each: np.ndarray
    slot: np.ndarray
    sequence: np.ndarray
    sequences: int


# A greedy pattern that fills less of the window than this is laid end to end instead.
FULL = 0.99


def solve(histogram: dict[int, int], units: int = WINDOW // UNIT) -> Plan:
    """Choose patterns of lengths and how often each repeats."""
    left = np.zeros(units + 1, np.int64)
    for length, count in histogram.items():
        left[length] += count
    patterns: list[tuple[dict[int, int], int]] = []

    def take(pattern: dict[int, int], times: int) -> None:
        times = min([times, *(int(left[b]) // m for b, m in pattern.items())])
        if times > 0:
            patterns.append((pattern, times))
            for b, m in pattern.items():
                left[b] -= m * times

    used = np.flatnonzero(left[1:]) + 1
    shapes = combinations(units)
    shapes = shapes[(np.isin(shapes, used) | (shapes == 0)).all(axis=1)]
    if len(shapes):
        a = np.zeros((units + 1, len(shapes)))
        np.add.at(a, (shapes.T, np.arange(len(shapes))), 1.0)
        a = a[1:]
        total = float(left.sum())
        # Long pieces are hard to place later, so leaving one over weighs more.
        weight = (np.arange(1, units + 1) / units) ** 2
        # Weights below half a sequence are rounded away, so the fit need not go further.
        x = nnls(a * weight[:, None], weight * left[1:] / total, 0.5 / total) * total
        for c in np.argsort(-x, kind="stable"):
            if x[c] >= 0.5:
                lengths, many = np.unique(shapes[c][shapes[c] > 0], return_counts=True)
                take(dict(zip(lengths.tolist(), many.tolist())), int(round(x[c])))
    # What rounding left over: the longest first, with the longest that still fit.
    loose = np.zeros(units + 1, np.int64)
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        pattern, room, free = {longest: 1}, units - longest, left.copy()
        free[longest] -= 1
        while room and (fits := np.flatnonzero(free[: room + 1])).size:
            b = int(fits[-1])
            many = min(int(free[b]), room // b)
            pattern[b] = pattern.get(b, 0) + many
            free[b] -= many
            room -= many * b
        if room <= units * (1 - FULL):
            take(pattern, int(left[longest]))
        else:
            loose[longest] += left[longest]
            left[longest] = 0

    rows, next_rank, sequence = [], np.zeros(units + 1, np.int64), 0
    for pattern, times in patterns:
        slot = 0
        for b, m in sorted(pattern.items(), reverse=True):
            rows.append((b, int(next_rank[b]), m, slot, sequence))
            next_rank[b] += m * times
            slot += m
        sequence += times
    at = 0
    for b in np.flatnonzero(loose)[::-1].tolist():
        rows.append((b, int(next_rank[b]), 0, at, sequence))
        at += b * int(loose[b])
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*table.T, sequence + -(-at // units))


def place(plan: Plan, bins: np.ndarray, rank: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, slot, and the unit after which the piece is cut (0: it is not)."""
    line = 1 << 50  # all lengths' ranks on one line, to search them at once
    row = np.searchsorted(plan.bin * line + plan.first, bins.astype(np.int64) * line + rank, "right") - 1
    nth, each = rank - plan.first[row], np.maximum(plan.each[row], 1)
    at = plan.slot[row] + nth * bins
    loose = plan.each[row] == 0
    sequence = plan.sequence[row] + np.where(loose, at // units, nth // each)
    slot = np.where(loose, at % units, plan.slot[row] + nth % each)
    cut = np.where(loose & (slot + bins > units), units - slot, 0)
    return sequence, slot, cut


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = cut.sparkSession
    held = stage(cut)
    units = window // UNIT
    counts = stage(held.groupBy("bin", "part").agg(F.count(F.lit(1)).alias("n")))
    # At most one row per unit length.
    histogram = {r["bin"]: r["n"] for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    plan = solve(histogram, units)
    before = W.partitionBy("bin").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("bin", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = held.select(*own, "bin", "part", "nth").join(base, ["bin", "part"])
    ranked = ranked.select(*own, "bin", "part", "nth", (F.col("base") + F.col("nth")).alias("rank"))

    first = ", ".join(f"{c} bigint" for c in own)
    schema = f"{first}, bin int, part int, nth bigint, sequence_id bigint, slot bigint, cut bigint"
    out = _arrow_schema(spark, schema)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = place(plan, batch.column("bin").to_numpy(), batch.column("rank").to_numpy(), units)
            arrays = [batch.column(f.name).cast(f.type) for f in list(out)[:-3]]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(w, pa.int64()) for w in where], schema=out)

    final = [*own, "sequence_id", "slot"]
    every = stage(ranked.mapInArrow(placed, schema))
    rows = every.where("cut = 0").select(*final)
    if (plan.each == 0).any():
        ids = held.where("raw IS NOT NULL").select("bin", "part", "nth", "width", "raw")
        parted = every.where("cut > 0").join(ids, ["bin", "part", "nth"])
        rows = rows.unionByName(_halves(parted.select(*final, "cut", "width", "raw")))
    earlier = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("slot")


def _halves(parted: DataFrame) -> DataFrame:
    """Two rows for each piece that a full window cuts: its end opens the next sequence."""
    names = parted.columns[:-3]
    schema = ", ".join(f"{c} bigint" for c in names)
    out = _arrow_schema(parted.sparkSession, schema)

    def halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, start, length, _, tokens, sequence, slot, cut, width, raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                at = cut * UNIT
                rows.append((doc, start, at, zlib.crc32(ids[:at].tobytes()), tokens, sequence, slot))
                rows.append((doc, start + at, length - at, zlib.crc32(ids[at:].tobytes()), tokens, sequence + 1, 0))
            columns = list(zip(*rows)) if rows else [[]] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return parted.mapInArrow(halved, schema)
