"""Rows that every operator must take: nulls, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

LONG = "lorem ipsum dolor sit amet " * 6000

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (3, None),
    (4, ""),
    (None, "a row without an id"),
    (None, None),
    (5, LONG),
    (6, "mail me at a.b@example.com or +1 (555) 010-2030, token = \"abcdef123456\""),
    (7, "  \n\t \x0b odd space é日本 <|endoftext|>  two  spaces\r\n"),
]
CLASHING = ["fp", "root", "cell", "score", "block", "bin", "rank", "part", "slot", "h", "depth", "__row", "first"]
DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(
    f"`{c}` string" for c in CLASHING
)


def odd(spark):
    rows = [(i, t, None, "s", None if t is None else len(t), *["x"] * len(CLASHING)) for i, t in TEXTS]
    return spark.createDataFrame(rows, DDL).repartition(3)


def none(spark):
    return spark.createDataFrame([], DDL)
