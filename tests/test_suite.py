"""Every registered query against its SQL, and the shape of its plan."""

from __future__ import annotations

import functools
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from dqstream.suite import oracle
from dqstream.suite import queries as suite


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module", autouse=True)
def signals_once():
    """Many queries start from the same signals table; compute it once here."""
    plain = suite.all_signals
    suite.all_signals = functools.cache(plain)
    yield
    suite.all_signals = plain


def cells(rows, columns):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


# Spark type name to the name the SQL side must have.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def test_every_query_has_its_sql():
    assert set(suite.all_queries()) == set(oracle.all_sql())
    assert set(suite.all_queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(suite.all_queries()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = suite.all_queries()[name](spark, sf_dir)
    want = duck.sql(oracle.all_sql()[name])
    assert {c: TYPES[t] for c, t in df.dtypes} == {c: str(t) for c, t in zip(want.columns, want.types)}
    assert cells(df.collect(), df.columns) == cells(want.fetchall(), want.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert bad not in plan


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 10


def test_only_the_needed_columns_are_read(spark, sf_dir):
    plan = suite.all_queries()["event_lag"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    read = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert read == "struct<event_id:bigint,ts:timestamp_ntz>"


def test_first_seen_is_cut_before_the_shuffle(spark, sf_dir):
    plan = suite.all_queries()["dedup_first_seen"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange")[-1]


def test_report_folds_before_the_shuffle(spark, sf_dir):
    plan = suite.all_queries()["batch_quality_report"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_count" in plan.split("Exchange")[-1]
