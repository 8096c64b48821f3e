"""Licence scan by a positional index of rare words, in DataFrame functions only.

The index holds, for every licence template, its words with their positions and a
weight: the inverse document frequency of the word, counted over all documents.
Of each file and template the rarest words that the file has are looked up. Every
place of the rarest one, less a position it has in the template, is a possible
start; the places of the other looked-up words must agree with it. At a start that
is left the template's mandatory key phrases are verified, word for word. Short
phrases must stand exactly; notices may shift by a few words (`slack`).

A place's score is the weight of the template words found there, as a share of
the template's weight: 1 for an exact phrase.

Nulls: a null text is empty. An empty text or table gives no words and no places;
repeated rows and rows without an id are rows like others. Words of any length and
texts of any length are taken whole; words of equal weight are ordered by
themselves. No column but doc_id and text is read.
"""

from __future__ import annotations

import json
import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqstream.llm.common import slim

# Words of a template that are looked up in a file.
LOOKED = 3
# How far the parts of a notice may be from their place, in words.
SLACK = 6

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence text in lower-case words, and the phrases that must be there."""

    label: str
    notice: str
    keys: tuple[str, ...]
    slack: int = SLACK
    base: bool = False


def phrase(label: str, words: str, base: bool = False) -> Template:
    """A template that must stand word for word."""
    return Template(label, words, (words,), 0, base)


# The three base phrases, and wording of public licences.
TEMPLATES = [
    phrase("mit", "under the mit license", base=True),
    phrase("apache-2", "apache license version 2", base=True),
    phrase("cc-by-nc", "cc by nc", base=True),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "to any person obtaining a copy"),
    ),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        ("apache license", "except in compliance with the license"),
    ),
    Template(
        "cc-by-nc",
        "licensed under the creative commons attribution noncommercial license",
        ("creative commons attribution noncommercial",),
    ),
    Template("cc-by-sa", "licensed under the creative commons attribution sharealike license", ("creative commons attribution sharealike",)),
    phrase("cc-by-sa", "cc by sa"),
    phrase("cc0", "cc0 1 0 universal"),
    Template("gpl-3", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    Template("lgpl", "licensed under the gnu lesser general public license version", ("lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license version", ("affero general public license",)),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("epl-2", "made available under the terms of the eclipse public license v 2 0", ("eclipse public license",)),
    phrase("boost-1", "boost software license version 1 0"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the"
        " following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify", "for any purpose with or without fee"),
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        ("free and unencumbered software", "public domain"),
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable",
        ("provided as is without any express or implied warranty", "in no event will the authors be held liable"),
    ),
]

_TEMPLATE = (
    "label string, base boolean, slack int, length int, total bigint, needs array<string>, "
    "words array<struct<word:string,weight:bigint,at:array<int>>>, keys array<struct<words:array<string>,at:int>>"
)


def words_of(text: Column) -> Column:
    """Lower-case words of a text; only A to Z change case."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _held(docs: DataFrame) -> DataFrame:
    """doc_id and words; the generator keeps later steps from cutting texts again."""
    rows = slim(docs, "doc_id", "text")
    return rows.select("doc_id", F.inline(F.array(F.struct(words_of(F.col("text")).alias("words")))))


def weights(docs: DataFrame, templates: list[Template] = TEMPLATES) -> dict[str, int]:
    """Weight of every template word: a thousand times the logarithm of its inverse document frequency.

    One row per word of the templates comes back, whatever the number of documents.
    """
    known = sorted({w for t in templates for w in t.notice.split()})
    # The empty word stands for the document itself.
    found = F.array_union(F.array(F.lit("")), F.array_intersect(F.array(*map(F.lit, known)), F.col("words")))
    counted = _held(docs).select(F.explode(found).alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in counted.collect()}
    return {w: 1 + math.floor(1000 * math.log((1 + counts.get("", 0)) / (1 + counts.get(w, 0))) + 0.5) for w in known}


def index(weight: dict[str, int], templates: list[Template] = TEMPLATES) -> list[dict]:
    """Per template its words, rarest first, with weights and positions, and its key phrases with theirs."""
    out = []
    for t in templates:
        notice = t.notice.split()
        ranked = sorted(set(notice), key=lambda w: (-weight[w], w))
        keys = [k.split() for k in t.keys]
        out.append(
            {
                "label": t.label,
                "base": t.base,
                "slack": t.slack,
                "length": len(notice),
                "total": sum(weight[w] for w in ranked),
                "needs": [w for w in ranked if any(w in k for k in keys)],
                "words": [{"word": w, "weight": weight[w], "at": [i for i, n in enumerate(notice) if n == w]} for w in ranked],
                "keys": [{"words": k, "at": next(i for i in range(len(notice)) if notice[i : i + len(k)] == k)} for k in keys],
            }
        )
    return out


def find(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words and its verified licence places in order.

    A place has the label, the word it starts at, its length in words, its score, and
    whether it is a base phrase.
    """
    known = index(weights(docs, templates), templates)
    templates_column = F.from_json(F.lit(json.dumps(known)), f"array<struct<{_TEMPLATE}>>")
    vocabulary = F.array(*[F.lit(w) for w in sorted({w["word"] for t in known for w in t["words"]})])
    rows = _held(docs).select("doc_id", "words", F.inline(F.array(F.struct(F.array_intersect(vocabulary, "words").alias("found")))))
    # Templates all of whose mandatory words the file has, with the file's rarest words of each.
    looked = F.transform(
        F.filter(templates_column, lambda t: F.forall(t.needs, lambda w: F.array_contains("found", w))),
        lambda t: F.struct(
            t.alias("t"),
            F.slice(F.filter(t.words, lambda w: F.array_contains("found", w.word)), 1, LOOKED).alias("rare"),
        ),
    )
    starts = F.transform(looked, lambda c: F.struct(c.t.alias("t"), c.rare.alias("rare"), _starts(c.rare[0]).alias("starts")))
    agreed = F.transform(starts, lambda c: F.struct(c.t.alias("t"), F.filter(c.starts, lambda o: _agrees(c, o) & _verified(c.t, o)).alias("starts")))
    places = F.flatten(F.transform(agreed, lambda c: F.transform(c.starts, lambda o: _place(c.t, o))))
    places = F.array_sort(F.array_distinct(places))
    return rows.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.inline(F.array(F.struct(places.alias("places")))))


def _starts(word: Column) -> Column:
    """Where the template would start, for every place of the word and every position it has in the template."""
    marked = F.transform("words", lambda w, i: F.when(w == word.word, i))
    places = F.filter(marked, lambda i: i.isNotNull())
    return F.flatten(F.transform(places, lambda p: F.transform(word.at, lambda t: p - t)))


def _agrees(c: Column, start: Column) -> Column:
    """Every looked-up word stands where the template has it, or `slack` words from there."""
    return F.forall(
        c.rare,
        lambda w: F.exists(
            w.at, lambda t: F.exists(F.sequence(-c.t.slack, c.t.slack), lambda d: F.get("words", start + t + d).eqNullSafe(w.word))
        ),
    )


def _verified(t: Column, start: Column) -> Column:
    """Every key phrase stands word for word within `slack` words of its place."""

    def stands(key: Column, at: Column) -> Column:
        return F.when(at >= 0, F.slice("words", at + 1, F.size(key.words)) == key.words).otherwise(False)

    return F.forall(
        t["keys"],
        lambda key: F.exists(F.sequence(start + key.at - t.slack, start + key.at + t.slack), lambda at: stands(key, at)),
    )


def _place(t: Column, start: Column) -> Column:
    first = F.greatest(start - t.slack, F.lit(0))
    stretch = F.slice("words", first + 1, F.greatest(start + t.length + t.slack - first, F.lit(0)))
    there = F.transform(F.array(stretch), lambda s: F.filter(t.words, lambda w: F.array_contains(s, w.word)))[0]
    weight = F.aggregate(there, F.lit(0).cast("bigint"), lambda a, w: a + w.weight)
    return F.struct(
        start.alias("start"),
        t.label.alias("label"),
        t.length.alias("length"),
        F.round(weight / t.total, 6).alias("score"),
        t.base.alias("base"),
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts and labels of the places that `find` gives."""
    base = F.filter("places", lambda p: p.base)

    def labels(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p.label))), ",")

    starts = F.transform(base, lambda p: p.start.cast("bigint"))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p.score)), F.lit(0.0)).alias("score"),
    )
