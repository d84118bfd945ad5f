"""Operator 7. Best-fit packing of tokenised documents with certified bin counts."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import common, segments

#: Pieces packed together in one task; rounds of exchange between groups that may waste sequences, of either kind; and
#: the share of a sequence, 1 / LOOSE, that is empty in those exchanged at the end.
GROUP, ROUNDS, LOOSE = 32_768, 4, 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", bin long, offset long, open boolean, loose boolean"


#: Segments the library encodes at once: what it returns for each takes many times their bytes.
AT_ONCE = 4096
#: Segments that are one word of letters which no normal form changes but for their case, and words to try that on.
_LETTERS = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_PLAIN = re.compile(f"[ \n]?([A-Za-z{_LETTERS}]+)")
_TRIED = ["the", " The", "\nQUEENS", " forêt", " naïveté", " MAßSTAB", f" {_LETTERS}", " unbelievably", "s", " zzzqqqxxx"]


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer, and a function from words that _PLAIN matches to their ids: the library's model on the lower-case
    word, without its costly general pattern. None where the tokenizer treats such words in another way."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    model, spelt = whole.model, {}
    for c in _LETTERS:
        parts = whole.pre_tokenizer.pre_tokenize_str(c) if whole.pre_tokenizer else []
        spelt[ord(c)] = parts[0][0] if len(parts) == 1 else "?"

    def one(word: str) -> list[int]:
        return [x.id for x in model.tokenize(word.lower().translate(spelt))]

    tried = [(x, m[1]) for x in _TRIED if (m := _PLAIN.fullmatch(x))]
    same = all(whole.encode(x, add_special_tokens=False).ids == one(w) for x, w in tried)
    return whole, one if same else None


def _coder(path: str) -> segments.SegmentCoder:
    whole, one = _tokenizer(path)

    def encode(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        out, sizes = [], []
        for lo in range(0, len(words), AT_ONCE):
            part = words.slice(lo, AT_ONCE).to_pylist()
            ids = [one(m[1]) if one and (m := _PLAIN.fullmatch(w)) else None for w in part]
            rest = [i for i, x in enumerate(ids) if x is None]
            for i, x in zip(rest, whole.encode_batch_fast([part[i] for i in rest], add_special_tokens=False), strict=True):
                ids[i] = x.ids
            sizes += [len(x) for x in ids]
            out.append(np.fromiter((i for x in ids for i in x), np.uint32, sum(sizes[lo:])))
        return np.concatenate(out), np.array(sizes, np.int64)

    # The pattern splits there too, whatever follows; special tokens hold none of these signs.
    return segments.SegmentCoder(segments.led_by((0x20, 0x0A), b".,;:!?"), encode)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 1) -> DataFrame:
    """Token pieces of at most capacity: (doc_id, piece, start, length, ids_crc32). The text's ids, then end_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer)
        for unit in segments.units(batches):
            ids, bounds = coder.ids(unit.column("text"))
            ids, at, out = ids.astype("<u4"), bounds.tolist(), ([], [], [], [], [])
            end = np.array([end_id], "<u4")
            for doc, lo, hi in zip(unit.column("doc_id").to_pylist(), at[:-1], at[1:], strict=True):
                own = np.concatenate([ids[lo:hi], end])
                for k, start in enumerate(range(0, len(own), capacity)):
                    cut = own[start : start + capacity]
                    for column, value in zip(out, (doc, k, start, len(cut), zlib.crc32(cut.tobytes())), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and offset of each item, and the room left in each bin."""
    bins, offsets, left = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_room, rooms = [[] for _ in range(capacity + 1)], 0  # bit r of rooms: some bin has exactly r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        if fit := rooms >> size:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i], left[b] = b, capacity - room, room - size
        if room > size:
            by_room[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, offsets, np.array(left, np.int64)


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """The best of two families of dual feasible functions: no packing has fewer bins. count: items by length, 0 to capacity."""
    size, total_size = np.arange(capacity + 1), int((np.arange(capacity + 1) * count).sum())
    best = -(-total_size // capacity)
    below, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    e = np.arange(1, capacity // 2 + 1)  # sizes over capacity - e count as whole, those under e as nothing
    kept = total[capacity - e + 1] - total[e] + capacity * (below[capacity + 1] - below[capacity - e + 1])
    best = max(best, int((-(-kept // capacity)).max(initial=0)))
    for k in range(1, 40):  # in units of 1 / (k * capacity): multiples of capacity / (k + 1) stay, others round
        scaled = size * (k + 1)
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


def counts(lengths: np.ndarray, capacity: int) -> np.ndarray:
    return np.bincount(lengths, minlength=capacity + 1)


def certified(placed: DataFrame, capacity: int) -> tuple[int, int]:
    """Sequences of a packing, and the dual-feasible bound of all its pieces together. One row a length is gathered."""
    rows = placed.groupBy("length").agg(F.count("*").alias("n"), F.count_if(F.col("offset") == 0).alias("bins")).toArrow()
    count = np.zeros(capacity + 1, np.int64)
    count[np.asarray(rows["length"], np.int64)] = np.asarray(rows["n"], np.int64)
    return int(sum(rows["bins"].to_pylist())), lower_bound(count, capacity)


def pack(items: DataFrame, capacity: int, group: int = GROUP) -> DataFrame:
    """Place rows with a length of 1 to capacity: adds sequence_id and offset.

    Rows are dealt evenly, whatever their ids, to groups of about `group` rows, each packed by best-fit decreasing in
    one task. A group whose bin count equals its dual-feasible lower bound is certified. From groups with a gap, the
    rows of bins that are not full go to new groups and are packed again; a round is kept if it saves bins. At the end
    the emptiest bins of all groups, certified ones too, exchange their rows in the same way, since the sum of the
    groups' bounds may exceed the bound of the whole. Only sums come to the driver. An empty table gives no rows.
    """
    names = [c.split()[0] for c in PIECES.split(", ")]

    def packed(rows: DataFrame, n: int, step: int) -> DataFrame:
        def place(pdf: pd.DataFrame) -> pd.DataFrame:
            lengths = pdf["length"].to_numpy()
            bins, offsets, left = best_fit(lengths, capacity)
            gap = len(left) > lower_bound(counts(lengths, capacity), capacity)
            pdf["bin"] = (pdf["g"] * group * 4 + bins) * (2 * ROUNDS + 1) + step
            pdf["offset"], pdf["open"], pdf["loose"] = offsets, gap & (left[bins] > 0), left[bins] * LOOSE >= capacity
            return pdf[[c.split()[0] for c in PLACED.split(", ")]]

        dealt = rows.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, -(-n // group)))))
        return common.materialize(dealt.groupBy("g").applyInPandas(place, PLACED), "packed")

    def bins_of(rows: DataFrame) -> tuple[int, int]:
        """Rows, and bins: every bin has one row at offset 0."""
        found = rows.agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        return found[0], found[1]

    items = common.materialize(items, "pieces")
    current, step = packed(items, items.count(), 0), 0
    for flag in ("open", "loose"):
        for _ in range(ROUNDS):
            moving = current.where(flag)
            n, before = bins_of(moving)
            if before < 2:
                break
            step += 1
            again = packed(moving.select(names), n, step)
            if bins_of(again)[1] >= before:
                break
            current = current.where(f"not {flag}").unionByName(again)
    return current.withColumnRenamed("bin", "sequence_id").drop("open", "loose")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096) -> DataFrame:
    """Pieces of all documents with their place: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A null or empty text is one piece of the end id. Rows that share an id, or have none, are packed each on its
    own. Only documents of more than capacity ids are cut. Other columns are ignored; an empty table gives no rows.
    """
    return pack(pieces(docs, tokenizer, capacity), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids."""
    import public_tokenizers

    return pack_documents(common.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
