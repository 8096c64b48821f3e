"""Quality scores from a factorization machine over words, structure and metadata.

Inputs are hashed words, statistics of the text's structure in coarse steps (how
much of it is marks, capitals, digits, repeated words or lines), and the length
that the table's `n_chars` column states, where there is one.

Nulls: a null text is scored like an empty one, a null n_chars is a value of its
own, a null doc_id is carried along and never learned from. A document with
several label rows takes the highest. Texts are read whole, repeated rows score
alike, an empty table gives no rows.
"""

from __future__ import annotations

import re
from itertools import islice
from operator import eq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqstream.llm import factorization as fm
from dqstream.llm.common import bucket_of

THRESHOLD = 0.3
_WORDS = re.compile(r"[^\W\d_]+").findall
_MARKS = re.compile(r"[^\w\s.,;:'\"()-]").findall
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]").findall
_DIGITS = re.compile(r"[0-9]").findall


def words(text: str | None, n_chars: int | None) -> set[str]:
    return set(_WORDS((text or "").lower()))


def structure(text: str | None, n_chars: int | None) -> dict[str, float]:
    """Statistics of the text in coarse steps, and its stated length."""
    text = text or ""
    tokens = text.split()
    found = _WORDS(text.lower())
    lines = text.split("\n")
    n, size = max(1, len(tokens)), max(1, len(text))
    marks = _MARKS(text)
    stats = {
        "marks": len(marks) * 40 / size,
        "kinds": min(8, len(set(marks))),
        "capitals": len(_CAPITALS(text)) * 10 / size,
        "digits": len(_DIGITS(text)) * 10 / size,
        "again": sum(map(eq, tokens, islice(tokens, 1, None))) * 20 / n,
        "distinct": len(set(found)) * 10 / max(1, len(found)),
        "lines": len(set(lines)) * 10 / len(lines),
        "breaks": min(9, len(lines) * 100 / n),
        "letters": min(15, sum(map(len, tokens)) / n),
        "alone": sum(len(t) == 1 for t in tokens) * 10 / n,
        "size": len(tokens).bit_length(),
    }
    out = {f"={name}:{int(value)}": 1.0 for name, value in stats.items()}
    out[f"=stated:{'none' if n_chars is None else int(n_chars).bit_length()}"] = 0.5
    return out


INPUTS = fm.Inputs(("text", "n_chars"), words, lambda word: [word], 0.3, structure)


def held_out(doc_id: Column) -> Column:
    """Rows no label may be learned from."""
    return F.coalesce(bucket_of(doc_id, 5) == 0, F.lit(True))


def _inputs(docs: DataFrame) -> DataFrame:
    stated = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return docs.select("doc_id", "text", stated.cast("bigint").alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame) -> fm.Machine:
    return fm.train(_inputs(docs), labels.where(~held_out(F.col("doc_id"))), "quality", INPUTS)


def score(docs: DataFrame, machine: fm.Machine) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return fm.apply(_inputs(docs), machine, INPUTS).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
