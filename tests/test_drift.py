"""Change of shape of payload values against plain counts."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dqstream.operators import drift as dr
from dqstream.session import configure
from dqstream.policy import starter

P = starter(drift_trailing_batches=3)


def rows_of(spark, batches, feed="main"):
    rows = [(feed, b, f'{{"price": {x}}}') for b, values in batches.items() for x in values]
    return configure(spark).createDataFrame(rows, "feed string, batch_id bigint, payload_json string")


def simple(batches, trailing=3):
    """psi and ks per batch, from whole lists of values."""

    def bucket(x):
        return 0 if x == 0 else math.copysign(math.floor(math.log(abs(x)) * dr.BUCKETS_PER_E) + 2000, x)

    out, ids = {}, sorted(batches)
    for i, b in enumerate(ids):
        past = [x for k in ids[max(0, i - trailing) : i] for x in batches[k] if isinstance(x, (int, float))]
        mine = [x for x in batches[b] if isinstance(x, (int, float))]
        own, base = Counter(map(bucket, mine)), Counter(map(bucket, past))
        keys = sorted(own | base)
        if not mine or not past:
            out[b] = (None, None)
            continue
        share = lambda c, n, k: (c[k] + 0.5) / (n + 0.5 * len(keys))
        psi = ks = up = 0.0
        for k in keys:
            o, e = share(own, len(mine), k), share(base, len(past), k)
            psi += (o - e) * math.log(o / e)
            up += own[k] / len(mine) - base[k] / len(past)
            ks = max(ks, abs(up))
        out[b] = (psi, ks)
    return out


def test_a_wider_spread_of_the_same_mean_is_flagged(spark):
    narrow = [96 + i % 9 for i in range(180)]
    wide = [100 + d * s for d in range(10, 100) for s in (-1, 1)]
    batches = {b: wide if b == 7 else narrow for b in range(1, 10)}
    df = rows_of(spark, batches)
    assert sum(wide) / len(wide) == sum(narrow) / len(narrow) == 100
    got = {r["batch_id"]: r for r in dr.shape_drift(df, "price", P).collect()}
    assert [b for b, r in got.items() if r["drifted"] and r["psi"] > 1] == [7]
    assert not any(r["drifted"] for r in dr.distribution_drift(df, "price", P).collect())


@pytest.mark.parametrize("span", [None, 2, 100_000])
def test_figures_equal_plain_counts(spark, span):
    """Negative values, zeros, ties, texts in place of numbers, and batches without a number."""
    batches = {b: [(-1) ** i * (i * b % 17) / 3 for i in range(5 + 3 * b)] + ['"x"', "null"] for b in range(9)}
    batches |= {4: ['"x"'], 5: ["null", "[]"], 20: [0, 0, 0], 21: [1e300, -1e-300]}
    got = {r["batch_id"]: r for r in dr.shape_drift(rows_of(spark, batches), "price", P, span=span).collect()}
    assert set(got) == set(batches)
    for b, (psi, ks) in simple(batches).items():
        assert got[b]["n"] == sum(isinstance(x, (int, float)) for x in batches[b])
        if psi is None:
            assert got[b]["psi"] is None and got[b]["ks"] is None and not got[b]["drifted"]
        else:
            assert got[b]["psi"] == pytest.approx(psi) and got[b]["ks"] == pytest.approx(ks)


def test_feeds_are_apart_and_empty_tables_give_no_rows(spark):
    one, two = rows_of(spark, {1: [1, 2], 2: [1, 2]}), rows_of(spark, {1: [900], 2: [1, 2]}, "other")
    both = {(r["feed"], r["batch_id"]): r for r in dr.shape_drift(one.unionByName(two), "price", P).collect()}
    assert both["main", 2]["psi"] == pytest.approx(0) and both["other", 2]["psi"] > 0.5
    assert dr.shape_drift(one.where(F.lit(False)), "price", P).count() == 0
