"""Cut parts out of documents: shared by line and substring dedup."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galley.llm import common, textkit

KEY, CUTS = "__galley_key", "__galley_cuts"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text) of the rows with text. id and key name a row; rows alike in both are cut alike."""
    text = F.col(f"`{text_col}`")
    return docs.where(text.isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


def cut(docs: DataFrame, cuts: DataFrame, cutter: Callable[[str, list[int]], str], id_col: str, text_col: str) -> DataFrame:
    """docs with cutter(text, cuts) as text where cuts (id, key, cuts array<int>) has the row, and n_chars to match.

    Rows without text or cuts pass unchanged; all columns are kept.
    """
    names = docs.columns
    sides = docs.withColumn(KEY, F.xxhash64(F.col(f"`{text_col}`"))).alias("d").join(
        common.large(cuts.select(F.col("id").alias("__galley_id"), F.col("key").alias("__galley_of"), F.col("cuts").alias(CUTS))),
        F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("__galley_id")) & (F.col(f"d.{KEY}") == F.col("__galley_of")),
        "left",
    )
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textkit.slices(whole, text_col, 1 << 24):
                columns = batch.columns[: len(names)]
                if batch.column(len(names)).null_count < batch.num_rows:
                    pairs = zip(columns[at].to_pylist(), batch.column(len(names)).to_pylist(), strict=True)
                    columns[at] = pa.array([cutter(t, c) if c else t for t, c in pairs], columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    out = sides.select(*[F.col(f"d.`{c}`") for c in names], CUTS).mapInArrow(run, schema)
    if "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, T.IntegralType):
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length(F.col(f"`{text_col}`")).cast(kind), F.col("n_chars")))
    return out
