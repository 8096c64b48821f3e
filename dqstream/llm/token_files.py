"""Token-ID files: concatenated ids with Elias-Fano coded document boundaries.

The format is a folder of Parquet files, so any store Spark can reach will do.
Each row is one block of consecutive documents:

    part, start     file number in document order; ids of that file before this block
    width, ids      bytes per id; the ids of all documents, little-endian, end to end
    ends            Elias-Fano code of the position after each document's last id
    nulls, base     documents without an id (they come first); the smallest id
    docs            Elias-Fano code of the other ids minus `base`

Nulls: a null text has no ids but the end id; a null doc_id sorts first. Equal
doc_ids keep the order they are read in. An empty table gives an empty folder.
Very long texts make a block of their own size; no other column is looked at.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dqstream.llm.common import _arrow_schema, slim, small_batches
from dqstream.llm.eliasfano import EliasFano
from dqstream.llm.encoder import encoder
from dqstream.plans.stage import shared_folder

END_ID = 2
# A block is closed once it holds this many ids.
BLOCK_IDS = 1 << 20

_CODE = "struct<n:int,low:int,lows:binary,highs:binary,samples:binary>"
_BLOCK = f"part int, start bigint, width int, ids binary, ends {_CODE}, nulls int, base bigint, docs {_CODE}"


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Encode whole texts and write their ids in ascending doc_id order."""
    schema = _arrow_schema(docs.sparkSession, _BLOCK)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        tail = np.array([end_id], "<u4").tobytes()
        ids: list[int | None] = []
        held: list[bytes] = []
        size = written = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                coded = enc.encode(text) + tail
                ids.append(doc)
                held.append(coded)
                size += len(coded) // 4
                if size >= BLOCK_IDS:
                    yield pa.RecordBatch.from_pylist([_block(part, written, ids, held)], schema)
                    written, size, ids, held = written + size, 0, [], []
        if held:
            yield pa.RecordBatch.from_pylist([_block(part, written, ids, held)], schema)

    keyed = slim(docs, "doc_id", "text").withColumn("__at", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange("doc_id", "__at").sortWithinPartitions("doc_id", "__at")
    ordered.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(blocks, _BLOCK).write.parquet(path)


def _block(part: int, start: int, ids: list, held: list[bytes]) -> dict:
    values = np.frombuffer(b"".join(held), "<u4")
    width = 2 if int(values.max()) < 1 << 16 else 4
    known = np.array([d for d in ids if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    return {
        "part": part,
        "start": start,
        "width": width,
        "ids": values.astype(f"<u{width}").tobytes(),
        "ends": vars(EliasFano.of(np.cumsum([len(h) // 4 for h in held]))),
        "nulls": len(ids) - len(known),
        "base": base,
        "docs": vars(EliasFano.of(known - base)),
    }


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 and, if wanted, its ids.

    `start` counts the ids of all documents before it. Blocks know their place
    in their file; only one total per file is summed up in one task.
    """
    schema = "doc_id bigint, part int, at bigint, n_tokens bigint, ids_crc32 bigint"
    schema += ", ids array<bigint>" if keep_ids else ""
    out = _arrow_schema(spark, schema)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1).to_pylist()[0]
                values = np.frombuffer(b["ids"], f"<u{b['width']}").astype("<u4")
                ends = EliasFano(**b["ends"]).all()
                starts = np.concatenate([[0], ends[:-1]])
                ids = [None] * b["nulls"] + (EliasFano(**b["docs"]).all() + b["base"]).tolist()
                raw = memoryview(values).cast("B")
                crcs = [zlib.crc32(raw[s * 4 : e * 4]) for s, e in zip(starts.tolist(), ends.tolist())]
                columns = [ids, [b["part"]] * len(ids), starts + b["start"], ends - starts, crcs]
                if keep_ids:
                    columns.append([values[s:e].tolist() for s, e in zip(starts.tolist(), ends.tolist())])
                arrays = [pa.array(c, f.type) for c, f in zip(columns, out)]
                yield pa.RecordBatch.from_arrays(arrays, schema=out)

    # Blocks are of megabytes, so a batch takes few.
    small_batches(spark)
    blocks = spark.read.schema(_BLOCK).parquet(path)
    rows = blocks.mapInArrow(documents, schema)
    sizes = blocks.groupBy("part").agg(F.sum(F.expr("length(ids) div width")).alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    kept = ["n_tokens", "ids_crc32", *(["ids"] if keep_ids else [])]
    return rows.join(first, "part").select("doc_id", (F.col("first") + F.col("at")).alias("start"), *kept)


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/dqstream-tokens/{uuid.uuid4().hex}"
