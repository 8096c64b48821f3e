"""Factorization machines over hashed terms, fitted on a bounded sample of labelled rows.

The score of a text is sigmoid(w0 + sum w_i x_i + pairs), where the pairwise part
sum_{i<j} <v_i, v_j> x_i x_j is computed in linear time as half of
(sum v_i x_i)^2 - sum (v_i x_i)^2. Terms are hashed into a fixed number of slots,
so a model has a fixed size however large the corpus is.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqstream.llm.common import BATCH_ROWS, _arrow_schema, slim

SLOTS = 1 << 17
RANK = 4
# Labelled rows a model is fitted on: at most this many of each label.
SAMPLE_PER_LABEL = 6_000
# Slots stay at zero that fewer sampled texts use, and those that say nothing: whose
# own use differs between the labels by fewer standard errors, and whose use together
# with any other slot does by fewer, beyond what the two say alone. There are many
# more pairs than slots, so a pair has to differ by more.
LEAST_TEXTS = 4
LEAST_ERRORS = 3.0
LEAST_PAIR_ERRORS = 6.0
# Slots are paired that this share of the sampled texts of a label use; that bounds
# the pairs, as a text uses a few hundred slots.
PAIRED_SHARE = 0.01
# Slots whose pairs are counted at once.
_BLOCK = 512
# How much more a row of the rarer label weighs than its share.
RARE_WEIGHT = 3.0
# Terms whose slot a worker remembers.
_REMEMBERED = 400_000

@dataclass(frozen=True)
class Inputs:
    """What a text is turned into: the terms of its words, each once, and further terms with amounts."""

    columns: tuple[str, ...]
    words: Callable[..., set[str]]
    terms: Callable[[str], list[str]]
    amount: float = 1.0
    extra: Callable[..., dict[str, float]] | None = None


class Hasher:
    """Slots and amounts of a row; remembers the words it has met, up to a bound.

    With `live`, slots that a model leaves at zero are left out.
    """

    def __init__(self, inputs: Inputs, live: np.ndarray | None = None) -> None:
        self._inputs, self._live = inputs, live
        self._known: dict[str, bytes] = {}

    def row(self, *values) -> tuple[np.ndarray, np.ndarray]:
        known, inputs = self._known, self._inputs
        words = inputs.words(*values)
        found = list(map(known.get, words))
        if None in found:
            if len(known) > _REMEMBERED:
                known.clear()
            for i, (slots, word) in enumerate(zip(found, words)):
                if slots is None:
                    found[i] = known[word] = self._slots(inputs.terms(word)).tobytes()
        slots = np.unique(np.frombuffer(b"".join(found), "<i4"))
        amounts = np.full(len(slots), inputs.amount, np.float32)
        if inputs.extra is None:
            return slots, amounts
        more = inputs.extra(*values)
        kept = [(int(s[0]), x) for t, x in more.items() if len(s := self._slots([t]))]
        at, x = zip(*kept) if kept else ((), ())
        return np.concatenate([slots, np.array(at, "<i4")]), np.concatenate([amounts, np.array(x, np.float32)])

    def _slots(self, terms: list[str]) -> np.ndarray:
        slots = np.array([zlib.crc32(t.encode()) % SLOTS for t in terms], "<i4")
        return slots if self._live is None else slots[self._live[slots]]


@dataclass(frozen=True)
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def live(self) -> np.ndarray:
        """Slots that matter to a score."""
        return (self.weights != 0) | (self.factors != 0).any(axis=1)

    def score(self, slots: np.ndarray, values: np.ndarray) -> float:
        linear = self.bias + float(self.weights[slots] @ values)
        v = self.factors[slots] * values[:, None]
        total = v.sum(axis=0)
        logit = linear + 0.5 * float(total @ total - (v * v).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30))))


def fit(
    rows: list[tuple[np.ndarray, np.ndarray]],
    labels: np.ndarray,
    shares: tuple[float, float],
    slots: int = SLOTS,
    epochs: int = 12,
    batch: int = 32,
    rate: float = 0.05,
    decay: float = 2e-4,
) -> Machine:
    """Logistic loss with adaptive steps. `shares` are the weights of labels 0 and 1.

    Rows of each label weigh as many rows as that label has among all labelled
    ones, but for RARE_WEIGHT.
    """
    rng = np.random.default_rng(7)
    used = telling([r[0] for r in rows], labels, slots) | paired([r[0] for r in rows], labels, slots)
    weights = np.zeros(slots, np.float32)
    factors = (rng.normal(0, 0.02, (slots, RANK)) * used[:, None]).astype(np.float32)
    seen_w, seen_v = np.full(slots, 1e-6, np.float32), np.full((slots, RANK), 1e-6, np.float32)
    rows = [(s[used[s]], x[used[s]]) for s, x in rows]
    weight = np.where(labels == 1, shares[1], shares[0])
    base = float((weight * labels).sum() / weight.sum())
    bias, seen_b = float(np.log(base / (1 - base))), 1e-6
    for epoch in range(epochs):
        step = rate / (1 + 0.3 * epoch)
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            size = np.array([len(rows[i][0]) for i in part])
            at = np.concatenate([rows[i][0] for i in part])
            x = np.concatenate([rows[i][1] for i in part])
            row = np.repeat(np.arange(len(part)), size)
            v = factors[at] * x[:, None]
            total = np.stack([np.bincount(row, v[:, f], len(part)) for f in range(RANK)], axis=1)
            square = np.bincount(row, (v * v).sum(axis=1), len(part))
            logit = bias + np.bincount(row, weights[at] * x, len(part)) + 0.5 * ((total**2).sum(axis=1) - square)
            miss = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[part]) * weight[part]
            touched, where = np.unique(at, return_inverse=True)
            g = miss[row] * x
            grad_w = np.bincount(where, g, len(touched)).astype(float) + decay * weights[touched] * len(part)
            pull = g[:, None] * (total[row] - v)
            grad_v = np.stack([np.bincount(where, pull[:, f], len(touched)) for f in range(RANK)], axis=1).astype(float)
            grad_v += 5 * decay * factors[touched] * len(part)
            seen_w[touched] += grad_w**2
            seen_v[touched] += grad_v**2
            weights[touched] -= (step * grad_w / np.sqrt(seen_w[touched])).astype(np.float32)
            factors[touched] -= (step * grad_v / np.sqrt(seen_v[touched])).astype(np.float32)
            grad_b = float(miss.sum())
            seen_b += grad_b**2
            bias -= step * grad_b / seen_b**0.5
    return Machine(bias, weights, factors)


def _used(rows: list[np.ndarray], labels: np.ndarray, slots: int) -> tuple[list[int], list[np.ndarray]]:
    """Per label: how many texts there are, and how many use each slot."""
    many, counts = [], []
    for y in (0, 1):
        own = [np.unique(r) for r, label in zip(rows, labels) if label == y]
        many.append(len(own))
        counts.append(np.bincount(np.concatenate(own), minlength=slots))
    return many, counts


def telling(rows: list[np.ndarray], labels: np.ndarray, slots: int) -> np.ndarray:
    """Which slots are used by enough texts, and by those of one label more than by the other's."""
    many, counts = _used(rows, labels, slots)
    both = counts[0] + counts[1]
    share = both / len(rows)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / many[0] + 1 / many[1]))
    apart = np.abs(counts[1] / many[1] - counts[0] / many[0]) / error
    return (both >= LEAST_TEXTS) & (apart >= LEAST_ERRORS)


def paired(rows: list[np.ndarray], labels: np.ndarray, slots: int) -> np.ndarray:
    """Which slots have a partner whose use goes with theirs in one label more than in the other.

    Per pair and label the covariance of the two uses is estimated with its error;
    the labels' covariances are compared. A pair of words that are equally common in
    both labels shows only here. All pairs of common slots are looked at, a block of
    slots against a block at a time.
    """
    many, counts = _used(rows, labels, slots)
    enough = np.maximum(counts[0] >= PAIRED_SHARE * many[0], counts[1] >= PAIRED_SHARE * many[1])
    common = np.flatnonzero(enough & (counts[0] + counts[1] >= LEAST_TEXTS))
    place = np.full(slots, -1, np.int32)
    place[common] = np.arange(len(common))
    rank = np.empty(len(rows), np.int32)
    for y in (0, 1):
        rank[labels == y] = np.arange(many[y])
    # Uses of common slots as (slot's place, text), in order of the place.
    at = place[np.concatenate(rows)]
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])[at >= 0]
    at = at[at >= 0]
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    blocks = range(0, len(common), _BLOCK)

    def uses(start: int) -> list[np.ndarray]:
        """Per label, which text uses which slot of a block."""
        part = slice(*np.searchsorted(at, [start, start + _BLOCK]))
        own, out = labels[row[part]], []
        for y in (0, 1):
            used = np.zeros((many[y], min(_BLOCK, len(common) - start)), np.float32)
            used[rank[row[part][own == y]], at[part][own == y] - start] = 1
            out.append(used)
        return out

    best = np.zeros(len(common), np.float32)
    for i in blocks:
        left = uses(i)
        for j in blocks[i // _BLOCK :]:
            right = left if i == j else uses(j)
            apart, error = np.float32(0), np.float32(0)
            for y, n in enumerate(many):
                p, q = left[y].mean(axis=0)[:, None], right[y].mean(axis=0)[None, :]
                together = left[y].T @ right[y] / n
                covariance = together - p * q
                # The mean square of (a - p) (b - q), for a and b of 0 and 1.
                square = together * ((1 - 2 * p) * (1 - 2 * q)) + p * q * ((1 - 2 * p) * q + p * (1 - q))
                apart = covariance - apart
                # One text more or less is never a difference.
                error = error + (np.maximum(square - covariance**2, 0) + 1 / n) / n
            errors = np.abs(apart) / np.sqrt(error)
            if i == j:
                np.fill_diagonal(errors, 0)
            for start, most in ((i, errors.max(axis=1)), (j, errors.max(axis=0))):
                np.maximum(best[start : start + _BLOCK], most, out=best[start : start + _BLOCK])
    out = np.zeros(slots, bool)
    out[common[best >= LEAST_PAIR_ERRORS]] = True
    return out


def sample(labels: DataFrame, label: str, per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """At most `per_label` ids of each label, as (doc_id, y), and how often each label occurs.

    Rows are taken in the order of a hash of their id, so the sample is the same
    however the table is cut. `labels` holds the rows one may learn from.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.col("doc_id").cast("string"))
    taken = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_label) for y in (0, 1)]
    return taken[0].unionByName(taken[1]), counts


def train(docs: DataFrame, labels: DataFrame, label: str, inputs: Inputs, per_label: int = SAMPLE_PER_LABEL) -> Machine:
    """Fit on a bounded sample; with fewer than two labels all texts score the label there is, or one half.

    Of rows that share a sampled id, the one with the smallest hash of its inputs is learned from.
    """
    chosen, counts = sample(labels, label, per_label)
    schema = "doc_id bigint, y int, h bigint, slots array<int>, amounts array<float>"
    out = _arrow_schema(docs.sparkSession, schema)

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        hasher = Hasher(inputs)
        # By id, of which there are as many as the sample holds.
        least: dict[int, tuple] = {}
        for batch in batches:
            for doc, y, h, *values in zip(*[c.to_pylist() for c in batch.columns]):
                if doc not in least or h < least[doc][2]:
                    least[doc] = (doc, y, h, *hasher.row(*values))
        kept = list(least.values())
        for k in range(0, len(kept), BATCH_ROWS):
            columns = zip(*kept[k : k + BATCH_ROWS])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    # The ids are bounded, so each executor may hold them; only hashed terms come back, one row an id.
    rows = slim(docs, "doc_id", *inputs.columns).join(F.broadcast(chosen), "doc_id")
    rows = rows.select(F.col("doc_id").cast("bigint"), "y", F.xxhash64(*inputs.columns), *inputs.columns)
    rows = rows.mapInArrow(hashed, schema).groupBy("doc_id", "y")
    rows = rows.agg(F.min_by(F.struct("slots", "amounts"), "h").alias("row")).select("doc_id", "y", "row.*").toArrow()
    rows = rows.sort_by([("doc_id", "ascending")]).combine_chunks()
    y = rows["y"].to_numpy().astype(np.float64)
    if len(set(y.tolist())) < 2:
        bias = 0.0 if not len(y) else 4.0 if y[0] else -4.0
        return Machine(bias, np.zeros(SLOTS, np.float32), np.zeros((SLOTS, RANK), np.float32))
    had = [int((y == k).sum()) for k in (0, 1)]
    shares = [counts[k] / had[k] * len(y) / sum(counts.values()) for k in (0, 1)]
    shares[int(counts[1] < counts[0])] *= RARE_WEIGHT
    # Views into two flat arrays, as Python numbers would take ten times the memory.
    ends = np.cumsum(rows["slots"].chunk(0).value_lengths().to_numpy())[:-1]
    slots, amounts = (np.split(rows[c].chunk(0).flatten().to_numpy(), ends) for c in ("slots", "amounts"))
    return fit(list(zip(slots, amounts)), y, (shares[0], shares[1]))


def apply(docs: DataFrame, machine: Machine, inputs: Inputs) -> DataFrame:
    """doc_id and score of every row."""
    schema = "doc_id bigint, score double"
    out = _arrow_schema(docs.sparkSession, schema)
    scorer = scores(docs, machine, inputs)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        score = scorer()
        for batch in batches:
            made = score(list(zip(*[c.to_pylist() for c in batch.columns[1:]])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64())], schema=out)

    rows = slim(docs, "doc_id", *inputs.columns).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(scored, schema)


def scores(docs: DataFrame, machine: Machine, inputs: Inputs) -> Callable[[], Callable[[list], list[float]]]:
    """Makes a function, once per task, that scores rows of inputs."""
    # Of a fixed size, so each executor may hold one.
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def scorer() -> Callable[[list], list[float]]:
        model = shared.value
        hasher = Hasher(inputs, model.live())
        return lambda rows: [model.score(*hasher.row(*row)) for row in rows]

    return scorer
