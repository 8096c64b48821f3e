"""Toxicity scores from a factorization machine over hashed terms.

Terms are the words of a text and their first letters, each counted once; pairs
of them, such as an insult and a group named with it, get their own weight.

Nulls: a null text is scored like an empty one; a null doc_id is carried along
and never learned from. A document with several label rows takes the highest.
Texts are read whole, repeated rows score alike, an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqstream.llm import factorization as fm
from dqstream.llm.common import bucket_of, keep_rows

THRESHOLD = 0.7
_WORDS = re.compile(r"[^\W\d_]+").findall
# Lengths of the word beginnings that are terms.
STARTS = (3, 5, 7)


def words(text: str | None) -> set[str]:
    return set(_WORDS((text or "").lower()))


def terms(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STARTS if len(word) > n)]


INPUTS = fm.Inputs(("text",), words, terms)


def held_out(doc_id: Column) -> Column:
    """Rows no label may be learned from."""
    return F.coalesce(bucket_of(doc_id, 3) == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame) -> fm.Machine:
    return fm.train(docs, labels.where(~held_out(F.col("doc_id"))), "toxic", INPUTS)


def score(docs: DataFrame, machine: fm.Machine) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return fm.apply(docs, machine, INPUTS).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, machine: fm.Machine) -> DataFrame:
    """Whole rows of `docs` that score below the threshold."""
    scorer = fm.scores(docs, machine, INPUTS)

    def chooser():
        score = scorer()
        return lambda rows: [s < THRESHOLD for s in score(rows)]

    return keep_rows(docs, chooser, INPUTS.columns)
