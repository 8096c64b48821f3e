from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dqstream.plans.scan import dense_rank_of_rows, running, streaks

SPANS = [3, 10, 1000, None]


def rows(seed):
    rng = random.Random(seed)
    out = []
    for feed in ("a", "b"):
        for at in sorted(rng.sample(range(60), 35)):
            out.append((feed, at, rng.randint(-5, 9), rng.random() < 0.5, rng.random() < 0.2))
    return out


SCHEMA = "feed string, at bigint, v bigint, counts boolean, breaks boolean"


def walk(data, start=None):
    """(sum, max, max before, streak) by stepping through the rows."""
    state = dict(start or {})
    out = {}
    for feed, at, v, counts, breaks in data:
        total, top, streak = state.get(feed, (0, None, 0))
        before = top
        total, top = total + v, v if top is None else max(top, v)
        streak = 0 if breaks else streak + int(counts)
        state[feed] = (total, top, streak)
        out[feed, at] = (total, top, before, streak)
    return out, state


def compute(spark, data, span, initial=None):
    df = spark.createDataFrame(data, SCHEMA)
    v = F.col("v")
    ran = running(df, ["feed"], ["at"], {"s": v}, {"m": v}, {"mb": v}, initial, span)
    both = streaks(ran, ["feed"], ["at"], {"k": (F.col("counts"), F.col("breaks"))}, initial, span)
    return {(r["feed"], r["at"]): (r["s"], r["m"], r["mb"], r["k"]) for r in both.collect()}


@pytest.mark.parametrize("span", SPANS)
def test_running_values_and_streaks(spark, span):
    data = rows(1)
    assert compute(spark, data, span) == walk(data)[0]


@pytest.mark.parametrize("span", [4, None])
def test_going_on_from_an_earlier_run(spark, span):
    data = rows(2)
    first, second = [r for r in data if r[1] < 30], [r for r in data if r[1] >= 30]
    _, state = walk(first)
    seed = [(f, s, m, m, k) for f, (s, m, k) in state.items()]
    initial = spark.createDataFrame(seed, "feed string, s bigint, m bigint, mb bigint, k bigint")
    whole = walk(data)[0]
    assert compute(spark, second, span, initial) == {k: v for k, v in whole.items() if k[1] >= 30}


def test_positions_do_not_depend_on_the_span(spark):
    data = [(r[0], r[1] * 7) for r in rows(3)]
    df = spark.createDataFrame(data, "feed string, at bigint")
    want = {}
    for feed in ("a", "b"):
        want.update({(feed, at): i for i, at in enumerate(sorted(a for f, a in data if f == feed))})
    for span in (1, 5, 10_000):
        got = dense_rank_of_rows(df, ["feed"], "at", "pos", span).collect()
        assert {(r["feed"], r["at"]): r["pos"] for r in got} == want
