"""Operator 3. Line dedup: content-defined chunks of lines, found again anywhere, compared and extended line by line."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import common, rewrite, textkit
from galley.llm.bloom import bloom, may_hold

U = np.uint64
#: Chunks on each side that a repeated one is extended into: where bounds differ, as at a passage's ends, they meet again
#: within as many.
BESIDE = 2


def hashed(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A rolling hash of each range of bytes."""
    return textkit.Rolling(textkit._TABLE[data], textkit._R).of(lo, hi)


class Lines:
    """The lines of texts that are not blank: where they begin and end in the bytes, with and without their newline, and
    the text each belongs to. Lines end with a newline, which belongs to them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        breaks = np.zeros(len(data), bool)
        if len(data):
            breaks[:-1] = data[:-1] == 10
            breaks[offsets[1:][np.diff(offsets) > 0] - 1] = True
        self.ends = np.flatnonzero(breaks) + 1
        self.starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        inked = np.concatenate([[0], np.cumsum(~textkit.SPACE[data])])
        self.solid = np.flatnonzero(inked[self.ends] > inked[self.starts])
        self.lo, self.hi = self.starts[self.solid], self.ends[self.solid]
        self.bare = self.hi - (data[self.hi - 1] == 10) if len(self.hi) else self.hi  # a last line may lack its newline
        self.row = np.searchsorted(offsets, self.lo, "right") - 1


def marks(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A rolling hash over the hashes of each line and the next one; the greatest number for a text's last line."""
    out = np.full(len(hashes), np.iinfo(np.uint64).max, U)
    if len(hashes) > 1:
        rolled = textkit.mix(hashes[:-1] * U(0x9E3779B97F4A7C15) + hashes[1:]) >> U(1)
        out[:-1] = np.where(row[1:] == row[:-1], rolled, out[:-1])
    return out


def chunk_starts(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether a chunk begins with a line.

    One does at a text's first line, and where the mark is less than the one before and no greater than the one after:
    that depends on four lines alone, so that text put in front moves chunks but does not change them. Chunks have two
    lines at least, three on average. In a run of equal lines, whose marks are equal, chunks are of two lines each, counted
    from the run's start; a run that repeats several lines has a least mark in each round.
    """
    n = len(hashes)
    first = np.ones(n, bool)
    first[1:] = row[1:] != row[:-1]
    if n < 3:
        return first
    m = marks(hashes, row)
    cut = np.zeros(n, bool)
    cut[1:-1] = (m[1:-1] < m[:-2]) & (m[1:-1] <= m[2:])
    equal = np.zeros(n + 1, bool)
    equal[1:n] = (hashes[1:] == hashes[:-1]) & ~first[1:]
    run = np.maximum.accumulate(np.where(equal[:n], 0, np.arange(n)))
    cut |= equal[:n] & equal[1:] & ((np.arange(n) - run) % 2 == 0)
    cut &= ~first
    cut[1:] &= ~first[:-1] & ~cut[:-1]
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    return first | (cut & ~last)


def chunks(lines: Lines, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of chunks of two lines or more: first and last line, text, and number in the text."""
    begins = np.flatnonzero(chunk_starts(hashed(data, lines.lo, lines.bare), lines.row))
    ends = np.append(begins[1:], len(lines.row)) - 1 if len(begins) else begins
    begins, ends = begins[ends > begins], ends[ends > begins]
    row = lines.row[begins]
    return begins, ends, row, np.arange(len(row)) - np.searchsorted(row, row)


CHUNK = "id long, key long, at int, h long"
BODY = CHUNK + ", first int, last int, body binary, before binary, after binary"


def _chunks(hash_of, bodies=None):
    """Rows of chunks: id, key, number in the text, hash. With a Bloom filter of hashes, of those in it also their first and
    last line in the text, their bytes, and those of BESIDE chunks on both sides, as far as there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textkit.slices(whole):
                data, offsets = textkit.utf8(batch.column("text"))
                lines = Lines(data, offsets)
                first, last, row, number = chunks(lines, data)
                lo, hi = lines.lo[first], lines.bare[last]
                h = hash_of(data, lo, hi).view(np.int64)
                keep = np.arange(len(h)) if bodies is None else np.flatnonzero(may_hold(bodies.value, h))
                rows = batch.select(["id", "key"]).take(pa.array(row[keep]))
                columns, names = [*rows.columns, pa.array(number[keep].astype(np.int32)), pa.array(h[keep])], ["id", "key", "at", "h"]
                if bodies is not None:
                    base, end = np.searchsorted(lines.row, row), np.searchsorted(row, row, "right")
                    i = np.arange(len(row))
                    far_lo, far_hi = lo[np.maximum(i - BESIDE, i - number)], hi[np.minimum(i + BESIDE, end - 1)]
                    cut = lambda a, b: pa.array([data[a[i] : b[i]].tobytes() for i in keep.tolist()], pa.binary())  # noqa: B023, E731
                    columns += [pa.array((x - base)[keep].astype(np.int32)) for x in (first, last)] + [cut(lo, hi), cut(far_lo, lo), cut(hi, far_hi)]
                    names = [c.split()[0] for c in BODY.split(", ")]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def solid_lines(part: bytes) -> list[bytes]:
    return [x for x in part.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]


def agreeing(a: list[bytes], b: list[bytes]) -> int:
    """How many lines from the start are equal."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, lo, hi): lines of a chunk that repeats another, and those beside it, on both sides, as far as each equals
    the line beside that other one."""
    for batch in batches:
        out = ([], [])
        for r in common.dicts(batch):
            left = agreeing(solid_lines(r["before"])[::-1], solid_lines(r["held_before"])[::-1])
            right = agreeing(solid_lines(r["after"]), solid_lines(r["held_after"]))
            out[0].append(r["first"] - left)
            out[1].append(r["last"] + right)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), *(pa.array(x, pa.int32()) for x in out)], ["id", "key", "lo", "hi"])


def _drop(text: str, cuts: list[int]) -> str:
    """cuts: first and last of the lines to remove, one pair after the other; blank lines between them go as well."""
    data = np.frombuffer(text.encode(), np.uint8)
    lines = Lines(data, np.array([0, len(data)]))
    gone = np.zeros(len(lines.starts) + 1, np.int64)
    np.add.at(gone, lines.solid[cuts[::2]], 1)
    np.add.at(gone, lines.solid[cuts[1::2]] + 1, -1)
    kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
    return b"".join(data[a:b].tobytes() for a, b in zip(lines.starts[kept].tolist(), lines.ends[kept].tolist(), strict=True)).decode()


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=hashed) -> DataFrame:
    """(id, key, cuts): first and last lines of what goes from a row.

    The first of equal chunks, by id (null ids first), key and place, stays. Hashes are counted before any text
    moves; only chunks whose hash repeats are shuffled, with their bytes and those of their neighbours, and each is compared
    with the first of its hash, byte for byte. Chunks that share a hash but not the bytes are compared among themselves in a
    second step. What equals its first one is extended line by line into its neighbours, as far as the first one's go on
    alike; a passage that ends inside a chunk is found whole so.
    """
    rows = rewrite.keyed(docs, id_col, text_col)
    found = common.materialize(rows.mapInArrow(_chunks(hash_of), CHUNK), "chunks")
    again = common.materialize(found.groupBy("h").count().where("count > 1").select("h"), "again")
    bodies = rows.mapInArrow(_chunks(hash_of, bloom(again)), BODY)
    bodies = common.materialize(bodies.join(common.large(again), "h", "left_semi").withColumn("place", F.struct("id", "key", "at")), "bodies")
    least = common.materialize(bodies.groupBy("h").agg(F.min("place").alias("place")), "first")
    renamed = [F.col("place").alias("kept"), F.col("body").alias("held"), F.col("before").alias("held_before"), F.col("after").alias("held_after")]
    held = bodies.join(common.large(least), ["h", "place"], "left_semi").dropDuplicates(["h"]).select("h", *renamed)
    held = common.materialize(held, "held")
    pairs = common.materialize(bodies.join(common.large(held), "h"), "compared")
    columns = ["id", "key", "first", "last", "before", "after", "held_before", "held_after"]
    same = pairs.where("body = held and place <> kept").select(*columns)
    clash = pairs.where("body <> held").drop("kept", "held", "held_before", "held_after")
    leading = clash.groupBy("h", "body").agg(F.min_by(F.struct("place", "before", "after"), "place").alias("f"))
    leading = leading.select("h", "body", F.col("f.place").alias("kept"), F.col("f.before").alias("held_before"), F.col("f.after").alias("held_after"))
    odd = clash.join(leading, ["h", "body"]).where("place <> kept").select(*columns)
    ranges = same.union(odd).mapInArrow(_extended, "id long, key long, lo int, hi int").distinct()
    cuts = ranges.groupBy("id", "key").agg(F.flatten(F.collect_list(F.array("lo", "hi"))).alias("cuts"))
    cuts = common.materialize(cuts, "cuts")
    common.release(found, again, bodies, least, held, pairs)
    return cuts


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=hashed) -> DataFrame:
    """docs without the passages of lines that repeat an earlier one anywhere in docs, as far as they hold a whole chunk.

    Blank lines, of white space alone, do not count as lines; those inside a passage are part of it. A single line that
    is repeated stays, and so may a passage of a few lines that lies across a chunk's bound. The first of equal lines always
    stays: whatever goes equals lines further in front. A text may end up empty; its row stays. Rows with the same id and
    text are cut alike. Null and empty texts pass unchanged; a text may be of any length, as its chunks are small; all
    columns are kept, and n_chars, if there, is set anew; an empty table stays empty.
    """
    return rewrite.cut(docs, repeats(docs, id_col, text_col, hash_of), _drop, id_col, text_col)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated passages of lines."""
    return line_dedup(common.read(spark, sf_dir, "documents"))
