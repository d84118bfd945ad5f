"""Incremental ingest of a folder of documents as a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, modificationTime timestamp, length long, content binary"


def listing(files: DataFrame, formats: tuple[str, ...] = ("epub", "pdf", "mobi", "azw3", "html")) -> DataFrame:
    """Supported files with their format and digest; the suffix is compared without case."""
    name = F.lower("path")
    kind = F.when(name.endswith(".kepub.epub"), "kepub").otherwise(F.regexp_extract(name, "\\.([a-z0-9]+)$", 1))
    return files.withColumn("format", kind).where(F.col("format").isin("kepub", *formats)).withColumn("sha256", F.sha2("content", 256))


def unchanged(found: DataFrame, books: DataFrame) -> DataFrame:
    """Files that are not indexed yet under the same path and digest."""
    return found.join(books.where("status = 'indexed'").select("path", "sha256"), ["path", "sha256"], "left_anti")


def watch(spark: SparkSession, folder: str, checkpoint: str, each: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Hand new files to `each`, batch by batch; a restart goes on where the last batch ended."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(folder)
    stream = listing(files).writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="5 minutes")).start()
