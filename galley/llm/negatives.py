"""Operator 11. Hard negatives: dense products of blocks of anchors with blocks of rows, in two passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.llm import common
from galley.llm.vectors import by_length, finite, matrix, typed, unpacked, whole

#: Rows in a block and anchors in a block. Speed only.
ROWS, ANCHORS = 4096, 512
BLOCKS = "block long, dim long, ids binary, labels binary, x binary, bars array<array<long>>"


def _blocks(limit: int, scale: int):
    """Blocks of at most limit rows of one vector length: ids, labels and floor(scale * component), in the order of ids;
    bars are the rows' positives, as far as given, as (id, score) one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, base = 0, TaskContext.get().partitionId() << 32
        held: dict[int, list[pa.RecordBatch]] = {}

        def close(dim: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            rows = pa.Table.from_batches(held.pop(dim)).sort_by("vec_id").combine_chunks().to_batches()[0]
            x = whole(matrix(rows.column("embedding"), rows.num_rows), scale)
            data = x.astype(np.int16) if np.abs(x).max(initial=0) < 2**15 else x
            blob = (b"2" if data.dtype == np.int16 else b"8") + data.tobytes()
            bars = rows.column("bars").to_pylist() if "bars" in rows.schema.names else []
            binary = [np.asarray(rows.column(c), np.int64).tobytes() for c in ("vec_id", "label")] + [blob]
            columns = [pa.array([base + number]), pa.array([dim]), *(pa.array([b], pa.binary()) for b in binary), pa.array([bars], pa.list_(pa.list_(pa.int64())))]
            return pa.RecordBatch.from_arrays(columns, ["block", "dim", "ids", "labels", "x", "bars"])

        for mixed in batches:
            for batch in by_length(mixed, "embedding"):
                dim = len(batch.column("embedding")[0]) if batch.num_rows else 0
                while batch.num_rows:
                    room = limit - sum(b.num_rows for b in held.get(dim, []))
                    held.setdefault(dim, []).append(batch.slice(0, room))
                    if batch.num_rows >= room:
                        yield close(dim)
                    batch = batch.slice(room)
        for dim in list(held):
            yield close(dim)

    return run


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: one matrix product in double precision where every sum stays below 2**53, else Python's
    integers."""
    wide = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if wide < 2**53:
        return (q @ x.T).astype(np.int64)
    out = typed(q, object) @ typed(x, object).T
    if out.size and not -(2**63) < out.min() <= out.max() < 2**63:
        raise OverflowError("a score is beyond 64 bits")
    return out.astype(np.int64)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each pair of blocks: the anchors' ids, labels and positives; the rows' ids and labels; the scores."""
    for batch in batches:
        for r in common.dicts(batch, 4):
            numbers = [np.frombuffer(r[c], np.int64) for c in ("aids", "alabels", "ids", "labels")]
            yield *numbers, r["bars"], products(unpacked(r["a"], r["dim"]), unpacked(r["x"], r["dim"]))


def _positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, label, ids, labels, _, score in _meetings(batches):
            out = []
            for i in range(len(own)):
                at = np.flatnonzero((labels == label[i]) & (ids != own[i]))
                if len(at) > k:  # all of the k-th score stay for the tie
                    at = at[score[i, at] >= np.partition(score[i, at], len(at) - k)[len(at) - k]]
                at = at[np.lexsort((ids[at], -score[i, at]))[:k]]
                out.append((np.full(len(at), own[i]), ids[at], score[i, at]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(k: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
        for own, label, ids, labels, bars, score in _meetings(batches):
            out = [[np.zeros(0, np.int64)] * 5]
            for i, bar in enumerate(bars):
                at = np.flatnonzero((labels != label[i]) & (ids != own[i]))
                at = at[np.argsort(-score[i, at], kind="stable")]  # rows of a block are in the order of ids
                falling = -score[i, at]
                for positive, p in zip(bar[::2], bar[1::2], strict=True):
                    first = int(np.searchsorted(falling, -(high * p // 100)))
                    last = min(first + k, int(np.searchsorted(falling, low * -p // 100, "right")))
                    if first < last:
                        found = at[first:last]
                        out.append([np.full(len(found), v) for v in (own[i], positive)] + [ids[found], np.full(len(found), p), score[i, found]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    return run


def _met(rows: DataFrame, anchors: DataFrame, shards: int) -> DataFrame:
    """Every block of anchors with every block of rows of its vector length: rows are dealt to slots, anchors go to each."""
    slots = max(1, min(shards, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    every = F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")
    copies = anchors.select("dim", F.col("ids").alias("aids"), F.col("labels").alias("alabels"), F.col("x").alias("a"), "bars", every)
    dealt = rows.drop("bars").withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int"))
    return dealt.join(common.large(copies), ["slot", "dim"]).select("dim", "ids", "labels", "x", "aids", "alabels", "a", "bars")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, rows: int = ROWS, anchors: int = ANCHORS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, label, embedding).

    Scores are integer inner products of floor(scale * x), x as double; higher ones come first, then smaller ids. An
    anchor's positives are its first rows of the same label, itself left out; for each, its negatives are the first rows
    of other labels with low percent of the positive's score <= score <= high percent, so that a positive of a negative
    score has none. Rows with a null id or label, or a vector that is null, empty, or holds a null or non-finite
    component, take no part; vectors of different length do not meet. Of anchor rows that share an id the one of the
    least vector asks; rows with the anchor's id are its own; as candidates, repeated rows count each. A score beyond
    64 bits raises an error. Other columns are ignored; an empty table gives no rows.

    Rows are cut into blocks whatever their labels, so that a frequent label is many blocks. Anchors are sent to as many
    slots as there are blocks, the shuffle partitions at most. The first pass keeps `positives` rows for each meeting of
    an anchor with a block and merges those; the second sends the anchors again with their positives' scores and keeps
    `negatives` rows for each window and block.
    """
    good = finite("embedding") & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    known = vectors.where(good).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding", is_anchor.alias("asks"))
    blocks = common.materialize(known.select("vec_id", "label", "embedding").mapInArrow(_blocks(rows, scale), BLOCKS), "rows")
    shards = blocks.count()
    least = F.min(F.struct("embedding", "label")).alias("m")
    asked = common.materialize(known.where("asks").groupBy("vec_id").agg(least).select("vec_id", "m.label", "m.embedding"), "anchors")
    first = _met(blocks, asked.mapInArrow(_blocks(anchors, scale), BLOCKS), shards)
    best = first.mapInArrow(_positives(positives), "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    best = best.withColumn("place", place).where(F.col("place") <= positives)
    bars = F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("found")  # at most `positives`
    bars = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(bars)
    bars = bars.select("vec_id", F.flatten(F.transform("found", lambda f: F.array(f["positive_id"], f["positive_score"]))).alias("bars"))
    armed = common.materialize(asked.join(common.large(bars), "vec_id").select("vec_id", "label", "embedding", "bars"), "armed")
    second = _met(blocks, armed.mapInArrow(_blocks(anchors, scale), BLOCKS), shards)
    found = second.mapInArrow(_negatives(negatives, low, high), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth of all embeddings; every seventh's label is the next one."""
    rows = common.read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.where("vec_id IS NOT NULL").withColumn("label", label), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS other, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
