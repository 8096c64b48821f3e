"""From raw documents to packed training sequences, stage by stage.

Every stage works on all rows its predecessor kept. The first three filter whole
rows, the fourth masks secrets in the texts, the last packs tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dqstream.llm import decontam, packing, secrets, simhash, toxicity
from dqstream.llm.common import read
from dqstream.llm.queries import VOCABULARY
from dqstream.plans.stage import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit the factorization machine on labelled rows of `docs`; rejected rows go."""
    machine = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, machine)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that of the smallest doc_id."""
    return simhash.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a passage of the benchmark go."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; secrets in their texts are masked."""
    return secrets.mask(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and offset."""
    return packing.pack(packing.pieces(docs, VOCABULARY))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("secrets", mask_secrets),
    ("packing", pack_tokens),
]

# Models and fingerprints are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each one's rows are written and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
