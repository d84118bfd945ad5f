"""Operator 4. Substring dedup by sliding spans of consecutive sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xxhash import xxh3_128_digest

from galley.llm import common, rewrite, textkit
from galley.llm.bloom import bloom, may_hold

#: A span has at least SENTENCES sentences and WORDS words. Sentences of more than LONG words are cut further, after
#: words whose hash is 0 modulo PART, so that tables and texts without full stops have spans too.
SENTENCES, WORDS, LONG, PART = 3, 12, 16, 8
U = np.uint64
WIDE = 1 << 31
_STOP, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_CLOSE[[ord(c) for c in "\"')]"]] = True


def spans(data: np.ndarray, offsets: np.ndarray):
    """Sentences and spans of texts: per sentence its first byte and row; per span its first sentence, its number of
    sentences and XXH3's 128 bits of its words, one blank between two and A-Z folded. From each sentence, and up to each
    sentence, the shortest run with enough sentences and words is a span."""
    starts, ends, bounds = textkit.word_spans(data, offsets)
    n = len(starts)
    row = np.searchsorted(offsets, starts, "right") - 1
    last = data[ends - 1] if n else np.zeros(0, np.uint8)
    inner = np.maximum(ends - 2, 0)
    stop = _STOP[last] | (_CLOSE[last] & (ends - starts > 1) & _STOP[data[inner]] if n else False)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    stop = np.array(stop, bool)
    if n:
        stop[:-1] |= (lines[starts[1:]] > lines[ends[:-1]]) | (row[1:] != row[:-1])
        stop[-1] = True
        heads = np.concatenate([[0], np.flatnonzero(stop)[:-1] + 1])
        size = np.diff(np.concatenate([heads, [n]]))
        long = np.flatnonzero(np.repeat(size > LONG, size))
        stop[long] |= textkit.word_hashes(*_apart(data, starts[long], ends[long])) % U(PART) == 0
    heads = np.concatenate([[0], np.flatnonzero(stop)[:-1] + 1]) if n else np.zeros(0, np.int64)
    tails = np.concatenate([heads[1:], [n]]) if n else heads
    of_row = row[heads]
    m = np.arange(len(heads))
    end = np.maximum(m + SENTENCES - 1, np.searchsorted(tails, heads + WORDS))
    fits = end < len(heads)
    fits[fits] &= of_row[end[fits]] == of_row[m[fits]]
    first, last = m[fits], end[fits]
    begin = np.minimum(m - SENTENCES + 1, np.searchsorted(heads, tails - WORDS, "right") - 1)
    fits = begin >= 0
    fits[fits] &= of_row[begin[fits]] == of_row[m[fits]]
    both = np.unique(np.concatenate([first * (len(m) + 1) + last, begin[fits] * (len(m) + 1) + m[fits]]))
    first, last = both // (len(m) + 1), both % (len(m) + 1)
    text, at = textkit.normal(data, starts, ends)
    view, lo, hi = memoryview(text), at[heads[first]].tolist(), at[tails[last]].tolist()
    h = np.frombuffer(b"".join([xxh3_128_digest(view[a:b]) for a, b in zip(lo, hi, strict=True)]), np.int64).reshape(-1, 2)
    return starts[heads], of_row, first, last - first + 1, (h[:, 0], h[:, 1])


def _apart(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some words alone, a blank after each, and their bounds."""
    size = ends - starts + 1
    stops = np.cumsum(size)
    at = np.repeat(starts - (stops - size), size) + np.arange(int(stops[-1]) if len(stops) else 0)
    out = np.concatenate([data, [np.uint8(32)]])[at]
    out[stops - 1] = 32
    return out, stops - size, stops - 1


def _spans(wanted=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textkit.slices(whole):
                data, offsets = textkit.utf8(batch.column("text"))
                _, of_row, first, size, (h1, h2) = spans(data, offsets)
                h1, h2 = np.ascontiguousarray(h1), np.ascontiguousarray(h2)
                if wanted is None:
                    yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2)], ["h1", "h2"])
                    continue
                keep = np.flatnonzero(may_hold(wanted.value, h1))
                at = first - np.searchsorted(of_row, of_row)[first]
                rows = batch.select(["id", "key"]).take(pa.array(of_row[first[keep]]))
                place = [pa.array(at[keep].astype(np.int32)), pa.array(size[keep].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, *place, pa.array(h1[keep]), pa.array(h2[keep])], ["id", "key", "at", "size", "h1", "h2"]
                )

    return run


def _drop(text: str, cuts: list[int]) -> str:
    """cuts: spans to remove, each its first sentence and number of sentences as one number."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts = spans(data, np.array([0, len(data)]))[0]
    edges = np.concatenate([starts, [len(data)]]).tolist()
    gone = {i for c in cuts for i in range(c // WIDE, c // WIDE + c % WIDE)}
    kept = [data[: edges[0]].tobytes()] + [data[a:b].tobytes() for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if i not in gone]
    return b"".join(kept).decode()


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, cuts): spans of a row that were seen before, as numbers that _drop reads.

    Spans are equal when 128 bits of a hash of their words are. The first of equal spans is by id (null ids first), key
    and place. Hashes are counted first, combined in each task; places are made only for spans whose hash repeats. No group of equal spans meets in one task.
    """
    rows = rewrite.keyed(docs, id_col, text_col)
    counted = rows.mapInArrow(_spans(), "h1 long, h2 long").groupBy("h1", "h2").count()
    again = common.materialize(counted.where("count > 1").select("h1", "h2"), "again")
    found = rows.mapInArrow(_spans(bloom(again.select("h1"))), "id long, key long, at int, size int, h1 long, h2 long")
    found = common.materialize(found.join(common.large(again), ["h1", "h2"], "left_semi").withColumn("place", F.struct("id", "key", "at")), "places")
    first = common.materialize(found.groupBy("h1", "h2").agg(F.min("place").alias("kept")), "first")
    late = found.join(common.large(first), ["h1", "h2"]).where("place <> kept")
    span = (F.col("at").cast("long") * WIDE + F.col("size")).alias("cut")
    cuts = common.materialize(late.select("id", "key", span).groupBy("id", "key").agg(F.collect_set("cut").alias("cuts")), "cuts")
    common.release(again, found, first)
    return cuts


def span_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the sentences that any non-first repeated span covers.

    A sentence ends after . ! or ?, at a newline, or at the text's end. A text may end up empty; its row stays. Rows
    with the same id and text are cut alike. Null and empty texts pass unchanged; texts may be of any length, a task holds
    one whole; all columns are kept and n_chars, if there, is set anew; an empty table stays empty.
    """
    return rewrite.cut(docs, covered(docs, id_col, text_col), _drop, id_col, text_col)


def op4_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without sentences covered by repeated spans."""
    return span_dedup(common.read(spark, sf_dir, "documents"))
