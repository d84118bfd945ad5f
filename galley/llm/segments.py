"""Tokenise the distinct segments of many texts once each, then spell every text from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from galley.llm import textkit

#: Bytes of text handled together; bytes that the segments remembered between such units of one task may take, with
#: their ids; the longest segment that is remembered. Speed and memory only.
UNIT, REMEMBER, LONGEST = 4 << 20, 32 << 20, 128


def units(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Record batches regrouped to about UNIT bytes of text each."""
    held, size = [], 0
    for batch in batches:
        for part in textkit.slices(batch, column, UNIT):
            n = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and size + n > UNIT:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            if part.num_rows:
                held.append(part)
                size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenation of flat[start : start + size]."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


class SegmentCoder:
    """Ids of texts. cuts(data, offsets) gives the segments' starts, which include the starts of texts that are not
    empty; encode gives the ids of distinct segments as (flat, sizes). No id may depend on what is beyond a segment.

    One coder serves one task: what it remembers, at most REMEMBER bytes, goes with it."""

    def __init__(self, cuts: Callable, encode: Callable) -> None:
        self.cuts, self.encode = cuts, encode
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the bounds of each (texts + 1)."""
        data, offsets = textkit.utf8(texts)
        starts = self.cuts(data, offsets)
        bounds = np.concatenate([starts, [len(data)]]).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
        pieces = pieces.dictionary_encode()
        codes, distinct = np.asarray(pieces.indices), pieces.dictionary
        at = np.asarray(pc.fill_null(pc.index_in(distinct, value_set=self.known), -1)).astype(np.int64)
        fresh = at < 0
        new = distinct.filter(pa.array(fresh))
        at[fresh] = len(self.known) + np.arange(len(new))
        flat, sizes = self.flat, self.sizes
        if len(new):
            own, lengths = self.encode(new)
            flat, sizes = np.concatenate([flat, own.astype(np.uint32)]), np.concatenate([sizes, lengths.astype(np.int32)])
        first = np.cumsum(sizes, dtype=np.int64) - sizes
        code = at[codes]
        lengths = sizes[code]
        out = gather(flat, first[code], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[np.searchsorted(starts, offsets)]
        if len(new):
            self._remember(new, own.astype(np.uint32), sizes[len(self.known) :])
        return out, ends

    def _remember(self, new: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        short = np.asarray(pc.binary_length(new)) <= LONGEST
        if not short.all():
            flat, sizes, new = flat[np.repeat(short, sizes)], sizes[short], new.filter(pa.array(short))
        added = new.nbytes + flat.nbytes + sizes.nbytes
        if self.known.nbytes + self.flat.nbytes + self.sizes.nbytes + added > REMEMBER:
            self.forget()
            if added > REMEMBER:
                return
        self.known = pa.concat_arrays([self.known, new])
        self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])


def led_by(white: tuple[int, ...], signs: bytes = b""):
    """Cut before every run of the bytes in white, before every sign that follows an ASCII letter, and at the start of
    every text."""
    table, mark, letter = (np.zeros(256, bool) for _ in range(3))
    table[list(white)] = True
    mark[list(signs)] = True
    letter[65:91] = letter[97:123] = True

    def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        blank = table[data]
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[1:] |= mark[data[1:]] & letter[data[:-1]]
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(first)

    return cuts
