"""Factorization machines, and the pipeline stage by stage."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dqstream.llm import factorization as fm
from dqstream.llm import packing, quality, queries, secrets, simhash, toxicity
from dqstream.plans.stage import stage

from .rows import TEXTS, none, odd
from .test_groups import Sets, hits_of, simple_fingerprint


def test_linear_time_score_equals_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    w, v = rng.normal(size=50), rng.normal(size=(50, 4))
    slots, x = np.array([3, 9, 20, 41]), np.array([1.0, 0.5, 2.0, 1.0])
    pairs = sum(v[a] @ v[b] * p * q for i, (a, p) in enumerate(zip(slots, x)) for b, q in list(zip(slots, x))[i + 1 :])
    logit = 0.1 + w[slots] @ x + pairs
    assert fm.Machine(0.1, w, v).score(slots, x) == pytest.approx(1 / (1 + np.exp(-logit)))


def test_a_pair_of_terms_is_learned():
    """Neither word alone tells the label, both together do."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array([k for k, used in ((1, a), (2, b), (10 + i % 5, True)) if used], np.int32))
        labels.append(float(a and b))
    rows = [(s, np.ones(len(s), np.float32)) for s in rows]
    machine = fm.fit(rows, np.array(labels), (1.0, 1.0), epochs=40)
    got = [machine.score(s, x) > 0.5 for s, x in rows]
    assert np.mean(np.array(got) == np.array(labels)) > 0.98


def test_a_pair_is_learned_whose_words_are_equally_common_in_both_labels():
    """The label is 1 with both words or with neither, among words that say nothing."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        slots = [k for k, used in ((1, a), (2, b)) if used] + rng.choice(np.arange(10, 400), 30, replace=False).tolist()
        rows.append((np.array(slots, np.int32), np.ones(len(slots), np.float32)))
        labels.append(float(a == b))
    labels = np.array(labels)
    used = [r[0] for r in rows]
    assert not fm.telling(used, labels, 400)[[1, 2]].any()
    assert fm.paired(used, labels, 400).nonzero()[0].tolist() == [1, 2]
    machine = fm.fit(rows[:2000], labels[:2000], (1.0, 1.0), slots=400)
    got = np.array([machine.score(*r) > 0.5 for r in rows[2000:]])
    assert np.mean(got == labels[2000:]) > 0.95


def test_pairs_are_compared_across_blocks(monkeypatch):
    """Blocks of any size give the errors of the plain formula, pair by pair."""
    rng = np.random.default_rng(4)
    labels = (rng.random(400) < 0.4).astype(float)
    table = rng.random((400, 13)) < rng.random(13) * 0.6
    table[labels == 1, 7] = table[labels == 1, 2]
    rows = [np.flatnonzero(r).astype(np.int32) for r in table]
    want = set()
    for a in range(13):
        for b in range(a):
            made = []
            for y in (0, 1):
                x = (table[labels == y][:, [a, b]] - table[labels == y][:, [a, b]].mean(axis=0)).prod(axis=1)
                made.append((x.mean(), (x.var() + 1 / len(x)) / len(x)))
            if abs(made[1][0] - made[0][0]) / (made[0][1] + made[1][1]) ** 0.5 >= fm.LEAST_PAIR_ERRORS:
                want |= {a, b}
    assert want == {2, 7}
    for block in (1, 3, 512):
        monkeypatch.setattr(fm, "_BLOCK", block)
        assert set(fm.paired(rows, labels, 20).nonzero()[0].tolist()) == want


def test_held_out_toxicity_of_the_table(spark, sf_dir):
    """The table's own labels, from ten times the rows: no false alarm, most toxic rows found."""
    folder = sf_dir.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = queries.op5_toxicity_machine(spark, folder).where("held_out").join(labels, "doc_id").where("toxic IS NOT NULL").collect()
    caught = [r["predicted"] for r in held if r["toxic"] == 1]
    assert np.mean([r["predicted"] for r in held if r["toxic"] == 0]) < 0.03 and np.mean(caught) > 0.6


def planted(spark):
    """Toxic rows hold two of eight words, the rest none; every third id is held out."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(300)]
    bad = "zark blorn quib frask vleed drun plox smeg".split()
    rows = []
    for i in range(900):
        text = list(rng.choice(words, 40))
        toxic = i % 4 == 0
        if toxic:
            text[5:7] = list(rng.choice(bad, 2, replace=False))
        rows.append((i, " ".join(text), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    return table.withColumn("n_chars", F.length("text").cast("bigint")), table.select("doc_id", "toxic", F.col("toxic").alias("quality"))


def test_held_out_toxicity_is_found(spark):
    docs, labels = planted(spark)
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.95
    # Held-out labels do not matter, nor do other columns.
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score(docs.withColumn("lang", F.lit("x")), toxicity.train(docs, turned)).collect()
    assert sorted((r["doc_id"], r["score"]) for r in again) == sorted((r["doc_id"], r["score"]) for r in got)


def test_held_out_quality_is_found(spark, sf_dir):
    """The table's own labels, from ten times the rows."""
    folder = sf_dir.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = queries.op9_quality_machine(spark, folder).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.9


def test_a_repeated_labelled_id_counts_once(spark, monkeypatch):
    """A third of all rows repeat one labelled id; another id has two texts."""
    docs, labels = planted(spark)
    same = docs.where("doc_id = 4").crossJoin(spark.range(450).select()).unionByName(docs)
    taken, real = [], fm.fit
    monkeypatch.setattr(fm, "fit", lambda rows, y, *a: (taken.append(len(rows)), real(rows, y, *a))[1])
    want, got = toxicity.train(docs, labels), toxicity.train(same, labels)
    assert taken[0] == taken[1] < 900
    assert got.bias == want.bias and (got.weights == want.weights).all() and (got.factors == want.factors).all()
    other = docs.where("doc_id = 4").withColumn("text", F.lit("zark other words"))
    both = [toxicity.train(same.unionByName(other).repartition(n), labels) for n in (1, 5)]
    assert taken[2:] == taken[:2] and (both[0].weights == both[1].weights).all()


def test_structure_tells_scattered_letters_and_ignores_white_space():
    assert "=alone:10" in quality.structure("a b c d e", None) and "=alone:0" in quality.structure("ab cd", None)
    assert "=letters:2" in quality.structure("ab" + " " * 50 + "cd", None)
    assert "=distinct:5" in quality.structure("Word word, WORD. other", None)
    assert "=distinct:0" in quality.structure(None, None)


def test_scores_of_odd_rows_and_labels(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (None, 1, 1), (5, None, None), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    for model in (toxicity, quality):
        for known in (labels, labels.limit(0)):
            rows = model.score(odd(spark), model.train(odd(spark), known)).collect()
            assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
            assert all(r["held_out"] for r in rows if r["doc_id"] is None)
        assert model.score(none(spark), model.train(none(spark), labels)).count() == 0
    kept = toxicity.keep_clean(odd(spark), toxicity.train(odd(spark), labels))
    assert kept.columns == odd(spark).columns


def test_pipeline_stages(spark, sf_dir):
    """Each stage against a plain version over what the one before it kept."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(step(spark, docs, sf_dir))
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in docs.collect()}
        kept[name] = (before, after)
        if name != "secrets":
            assert all(before[i] == r for i, r in after.items())
    before, after = kept["near_copies"]
    prints = {i: simple_fingerprint(r["text"]) for i, r in before.items()}
    sets = Sets(before)
    for a in before:
        for b in before:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= simhash.BUDGET:
                sets.link(a, b)
    assert set(after) == {i for i in before if sets.find(i) == i}
    before, after = kept["benchmark"]
    assert set(after) == {i for i, r in before.items() if not hits_of(r["text"], items)[4]}
    before, after = kept["secrets"]
    assert {i: r["text"] for i, r in after.items()} == {i: secrets.masked(r["text"]) for i, r in before.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(after)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(f"n > {packing.WINDOW}").isEmpty()
