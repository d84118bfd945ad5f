"""Shared helpers: reading tables, durable intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Folders of sessions without spark.checkpoint.dir, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. One of our own serves only where that is unset and all tasks
    run in this machine's one process, as in tests; a running session takes no such setting, so it is remembered here."""
    context, found = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-galley-")
        found = _OWN[context.applicationId]
    return f"{found}/galley-{context.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage so that lost executors cost a re-read, not a recomputation, and gives later joins a
    measured size: Spark broadcasts what is small and shuffles the rest, splitting skewed partitions.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete materialized tables that only written results have read."""
    for df in frames:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def large(df: DataFrame) -> DataFrame:
    """Mark a join side that grows with the input: it is shuffled and sorted at every size, never broadcast."""
    return df.hint("merge")


def dicts(batch: pa.RecordBatch, rows: int = 500) -> Iterator[dict]:
    """Rows of a batch as dictionaries, made a few at a time. Spark bounds batches by bytes as well as by rows."""
    for at in range(0, batch.num_rows, rows):
        yield from batch.slice(at, rows).to_pylist()
