"""A Bloom filter of fixed size, sent to all tasks to drop most rows that a later exact join would drop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.llm.textkit import mix

#: 2**BITS bits are 4 MB, whatever the input; with far more members the filter lets more rows through, never fewer.
BITS = 25
U = np.uint64


def _places(values: np.ndarray) -> list[np.ndarray]:
    h = mix(values.view(U))
    return [(h >> U(s)) & U(2**BITS - 1) for s in (0, 32)]


def bloom(members: DataFrame):
    """Broadcast bitmap of a frame's only column, of longs. Tasks make bitmaps, which are combined in Spark."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(2**BITS // 64, U)
        for batch in batches:
            for at in _places(np.asarray(batch.column(0).drop_null(), np.int64)):
                np.bitwise_or.at(held, at >> U(6), U(1) << (at & U(63)))
        words = np.flatnonzero(held)
        for part in np.array_split(words, len(words) // 100_000 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(held[part].view(np.int64))], ["word", "mask"])

    rows = members.mapInArrow(bits, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    whole = np.zeros(2**BITS // 64, U)
    whole[np.asarray(rows["word"])] = np.asarray(rows["mask"]).view(U)
    return members.sparkSession.sparkContext.broadcast(whole)


def may_hold(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """False only for values that are surely not members."""
    out = np.ones(len(values), bool)
    for at in _places(np.ascontiguousarray(values)):
        out &= (bitmap[at >> U(6)] >> (at & U(63))) & U(1) == 1
    return out
