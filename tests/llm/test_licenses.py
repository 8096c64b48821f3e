"""The licence index against plain Python."""

from __future__ import annotations

import math
import random
import re

import pytest

from dqstream.llm import licenses

from .rows import none, odd


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def base(text):
    """(start, label) of every base phrase."""
    cut = words(text)
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    return sorted((i, label) for p, label in phrases.items() for i in range(len(cut)) if cut[i : i + len(p.split())] == p.split())


def plain(docs):
    """All places by looking at every start of every template."""
    held = [words(t) for t in docs]
    known = {w for t in licenses.TEMPLATES for w in t.notice.split()}
    df = {w: sum(w in h for h in map(set, held)) for w in known}
    weight = {w: 1 + math.floor(1000 * math.log((1 + len(held)) / (1 + df[w])) + 0.5) for w in known}
    return [sorted({p for t in licenses.TEMPLATES for p in places(cut, t, weight)}) for cut in held]


def places(cut, t, weight):
    notice, slack = t.notice.split(), t.slack
    spread = range(-slack, slack + 1)
    there = [w for w in sorted(set(notice), key=lambda w: (-weight[w], w)) if w in cut]
    rare = there[: licenses.LOOKED]
    at = {w: [i for i, n in enumerate(notice) if n == w] for w in notice}

    def word(i):
        return cut[i] if 0 <= i < len(cut) else None

    def stands(key, i):
        return i >= 0 and cut[i : i + len(key)] == key

    for start in {p - i for p, w in enumerate(cut) if rare and w == rare[0] for i in at[w]}:
        if not all(any(word(start + i + d) == w for i in at[w] for d in spread) for w in rare):
            continue
        keys = [k.split() for k in t.keys]
        first = [next(i for i in range(len(notice)) if notice[i : i + len(k)] == k) for k in keys]
        if all(any(stands(k, start + i + d) for d in spread) for k, i in zip(keys, first)):
            stretch = set(cut[max(start - slack, 0) : max(start + len(notice) + slack, 0)])
            score = sum(weight[w] for w in set(notice) & stretch) / sum(weight[w] for w in set(notice))
            yield start, t.label, len(notice), round(score, 6), t.base


TEXTS = [
    "Released under the MIT License, under-the-mit/license.",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache license apache license version 2 version 2",
    "cc by cc by nc by nc CC-BY-NC 4.0; cc by sa",
    "Permission is hereby granted, free of charge, to any person who is obtaining a copy",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of the program",
    "general public license version 3", "GNU General Public License, oh well, version 3", "GENERAL PUBLIC LICENSE VERSION 3 GNU",
    "mit mıt MİT under the mit licenseé under the mit license2", "the the the of of license", None, "", "É à license",
    "Redistribution and use in source and binary forms, with or without changes, are permitted",
    "license " * 3000 + "under the mit license",
]


def test_places_equal_those_of_every_start(spark):
    random.seed(5)
    vocabulary = [w for t in licenses.TEMPLATES for w in t.notice.split()]
    texts = TEXTS + [" ".join(random.choices(vocabulary, k=random.randint(0, 40))) for _ in range(150)]
    for _ in range(150):
        # Notices with a few words left out, put in or changed.
        notice = random.choice(licenses.TEMPLATES).notice.split() * random.randint(1, 2)
        for _ in range(random.randint(0, 3)):
            i = random.randrange(len(notice))
            notice[i : i + random.randint(0, 1)] = random.choices(vocabulary, k=random.randint(0, 2))
        texts.append(" ".join(random.choices(vocabulary, k=9) + notice + random.choices(vocabulary, k=4)))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    rows = sorted(licenses.find(frame).collect())
    for row, want, text in zip(rows, plain(texts), texts):
        assert row["n_words"] == len(words(text))
        got = [tuple(p) for p in row["places"]]
        assert [p[:3] + p[4:] for p in got] == [p[:3] + p[4:] for p in want]
        assert [p[3] for p in got] == pytest.approx([p[3] for p in want], abs=2e-6)
        assert [(p[0], p[1]) for p in got if p[4]] == base(text)
    labels = {r["doc_id"]: r["labels"] for r in licenses.digest(licenses.find(frame)).collect()}
    assert [labels[i] for i in range(9)] == ["mit", "apache-2", "apache-2", "cc-by-nc,cc-by-sa", "", "mit", "gpl-3", "", "gpl-3"]


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, "under the mit license")], "doc_id bigint, text string")
    plan = licenses.digest(licenses.find(frame))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_rows_and_an_empty_table(spark):
    got = licenses.digest(licenses.find(odd(spark))).collect()
    assert sorted(r["n_words"] for r in got) == sorted(len(words(r["text"])) for r in odd(spark).collect())
    assert {(r["n_base"], r["first_word"], r["labels"], r["score"]) for r in got} == {(0, None, "", 0.0)}
    assert licenses.digest(licenses.find(none(spark))).count() == 0
