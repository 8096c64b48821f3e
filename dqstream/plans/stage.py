"""Write a small result once and read it back with real size statistics.

Batch-level rows (one per micro-batch) feed several later steps. Staging them
keeps those steps from scanning the events again, and a parquet table gives
the planner true sizes, so that it broadcasts only what is small.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    named = tempfile.mkdtemp(prefix="dqstream-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def stage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and return a reader of that table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/dqstream-stage/{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in getattr(_scopes, "open", []):
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Remove the tables staged inside the block when it ends.

    For jobs that stage again and again, such as the epochs of a stream.
    """
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    paths: list[str] = []
    _scopes.open.append(paths)
    try:
        yield
    finally:
        # Taken out by identity: two empty lists are equal.
        _scopes.open = [s for s in _scopes.open if s is not paths]
        for path in paths:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
