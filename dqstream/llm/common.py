"""Small helpers the operators of this folder share."""

from __future__ import annotations

import os
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts reach a Python task in batches of at most this many rows and bytes.
BATCH_ROWS = 256
BATCH_BYTES = 16 << 20

# A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound what one Arrow batch holds; texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def slim(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that other columns cannot clash."""
    small_batches(docs.sparkSession)
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def per_row(docs: DataFrame, schema: str, made: Callable[[list], list], keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The key columns, and one column per list that `made(texts)` gives for each Arrow batch."""
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys) + ", " + schema
    out = _arrow_schema(docs.sparkSession, schema)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [batch.column(i).cast(out.field(i).type) for i in range(n)]
            columns = made(batch.column(n).to_pylist())
            arrays += [pa.array(c, out.field(n + i).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return slim(docs, *keys, "text").mapInArrow(run, schema)


def keep_rows(docs: DataFrame, choose: Callable[[], Callable[[list], list[bool]]], inputs: Sequence[str]) -> DataFrame:
    """Whole rows of `docs` for which a chooser, made once per task, says yes."""
    small_batches(docs.sparkSession)
    at = [docs.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = choose()
        for batch in batches:
            yield batch.filter(pa.array(chosen(list(zip(*[batch.column(i).to_pylist() for i in at]))), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def bucket_of(id_column: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo `parts`."""
    return F.crc32(id_column.cast("string").cast("binary")) % parts


class Reach:
    """How far the spans that start before a position reach; built once, asked in logarithmic time."""

    def __init__(self, spans: Iterable[tuple[int, int]]) -> None:
        self._starts, self._ends = [], []
        for start, end in sorted(spans):
            self._starts.append(start)
            self._ends.append(max(end, self._ends[-1]) if self._ends else end)

    def until(self, position: int) -> int:
        """The furthest end among spans that start before `position`."""
        i = bisect_left(self._starts, position)
        return self._ends[i - 1] if i else -1


def quiet_tokenizers() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
