"""The filter audit: against plain Python, over micro-batches, a restart and odd rows."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from dqstream.llm import audit

from .rows import none, odd

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
LABELS = "doc_id bigint, quality int, toxic int, part string, salt int"


def judged(docs, labels):
    """(part, failing filters, good, toxic) of every row."""
    least = {}
    for doc, text, _ in docs:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    for doc, text, source in docs:
        text = text or ""
        words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        fails += "E" * (doc is not None and doc > least[text])
        yield source or "", fails, *(any(r[0] == doc is not None and r[i] == 1 for r in labels) for i in (1, 2))


def plain(docs, labels):
    """The report, order by order and row by row."""
    out, total = Counter(), Counter()
    rows = list(judged(docs, labels))
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, name in enumerate(order, 1):
                own = [r for r in left if name in r[1]]
                left = [r for r in left if name not in r[1]]
                fail = [r for r in rows if r[0] == part and name in r[1]]
                lone = sum(r[1] == name for r in fail)
                total[part, name] += len(own)
                out[part, order, step] = (len(left), len(own), len(fail) - len(own), lone, sum(r[2] for r in own), sum(r[3] for r in own))
    return sorted((*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def told(frame):
    return sorted(tuple(r) for r in frame.select(*COLUMNS).collect())


LONG = " ".join(f"w{i}" for i in range(250))
DOCS = [
    (9, LONG, "a"), (8, LONG, "b"), (3, LONG, "a"), (3, LONG, "b"), (3, LONG, "b"), (None, LONG, "a"),
    (7, "x " * 300, "a"), (6, "x " * 300, None), (5, "SHOUT & more", "b"), (4, "", "a"), (2, None, "a"), (1, "é #", ""),
]
MARKS = [(3, 1, 0, "p", 0), (3, 0, 1, "p", 0), (9, 1, None, "p", 0), (None, 1, 1, "p", 0), (7, 0, 1, "p", 0), (2, 1, 1, "p", 0), (99, 1, 1, "p", 0)]


def written(spark, rows, folder, files):
    """The rows in the given order, dealt over Parquet files that are read one after the other."""
    size = -(-len(rows) // files)
    for i in range(files):
        frame = spark.createDataFrame(rows[i * size : (i + 1) * size], "doc_id bigint, text string, source string")
        frame.withColumn("part", F.lit("x")).withColumn("mask", F.lit(1)).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("backwards", [False, True])
def test_smaller_ids_that_arrive_later_retract(spark, tmp_path, backwards):
    docs = DOCS[::-1] if backwards else DOCS
    written(spark, docs, str(tmp_path / "d"), 6)
    labels = spark.createDataFrame(MARKS, LABELS)
    assert told(audit.audit(spark, str(tmp_path / "d"), labels, files_per_batch=1)) == plain(DOCS, MARKS)


def test_counters_of_a_batch_hold_retractions_and_a_restart_goes_on(spark, tmp_path):
    source, folder = str(tmp_path / "d"), str(tmp_path / "audit")
    labels = spark.createDataFrame(MARKS, LABELS)
    for rows in (DOCS[:2], DOCS[2:]):
        written(spark, rows, source, 1)
        schema = spark.read.parquet(source).schema
        audit.counters(spark.readStream.schema(schema).parquet(source), labels, folder)
    held = spark.read.parquet(f"{folder}/counters")
    # 8 stood for the text until 3 came.
    assert held.where("epoch = 0 AND part = 'b' AND mask = 0").first()["n"] == 1
    assert held.where("epoch = 1 AND part = 'b' AND mask = 0").agg(F.sum("n")).first()[0] == 1
    assert held.where("epoch = 1 AND part = 'b' AND mask = 16").agg(F.sum("n")).first()[0] == 1
    assert told(audit.report(spark, folder)) == plain(DOCS, MARKS)


def test_a_hot_text_is_folded_and_odd_tables_are_taken(spark, tmp_path):
    docs = [(i * 7919 % 3000, LONG if i % 3 else f"{LONG} {i}", f"s{i % 4}") for i in range(3000)]
    marks = [(i, i % 2, i % 5 == 0 and 1 or 0, "p", 0) for i in range(0, 3000, 3)]
    written(spark, docs, str(tmp_path / "hot"), 3)
    labels = spark.createDataFrame(marks, LABELS)
    assert told(audit.audit(spark, str(tmp_path / "hot"), labels, files_per_batch=2)) == plain(docs, marks)
    odd(spark).write.parquet(str(tmp_path / "odd"))
    rows = [(r.doc_id, r.text, r.source) for r in odd(spark).collect()]
    assert told(audit.audit(spark, str(tmp_path / "odd"), labels.limit(0))) == plain(rows, [])
    none(spark).write.parquet(str(tmp_path / "none"))
    assert told(audit.audit(spark, str(tmp_path / "none"), labels)) == []


def test_labels_that_are_small_on_disk_only_are_not_broadcast(spark, tmp_path):
    docs = [(i, f"{LONG} {i % 900}", f"s{i % 4}") for i in range(1000)]
    marks = [(i, 1, i % 2, "p", 0) for i in range(40_000)]
    written(spark, docs, str(tmp_path / "d"), 2)
    # Under the broadcast threshold as files, tens of MB as a table of rows.
    spark.createDataFrame(marks, LABELS).coalesce(1).write.parquet(str(tmp_path / "l"))
    labels = spark.read.parquet(str(tmp_path / "l"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "4m")
    try:
        assert told(audit.audit(spark, str(tmp_path / "d"), labels, files_per_batch=1)) == plain(docs, marks[:1000])
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
