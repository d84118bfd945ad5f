"""Vectorised work on UTF-8 bytes: words, lines and sentences of many texts at once, and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
_rng = np.random.default_rng(20_240_901)
_TABLE = _rng.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_R, _Q = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def _inverse(x: U) -> U:
    """Of an odd number modulo 2**64."""
    return U(pow(int(x), -1, 2**64))


class _Powers:
    """base**i modulo 2**64 for i in 0..n, grown on demand."""

    def __init__(self, base: U) -> None:
        self.base, self.known = base, np.ones(1, U)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) <= n:
            size = 1 << int(n).bit_length()
            steps = np.full(size + 1, self.base, U)
            steps[0] = 1
            self.known = np.multiply.accumulate(steps)
        return self.known


_POW = {b: (_Powers(b), _Powers(_inverse(b))) for b in (_R, _Q)}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


class Rolling:
    """Hashes of any ranges of a sequence of numbers, by prefix sums of a polynomial modulo 2**64. Some sequences collide
    whatever the base, so these are never taken as equality: what has equal ones is compared byte by byte, or they only
    choose where to cut."""

    def __init__(self, values: np.ndarray, base: U = _Q) -> None:
        self.base, n = base, len(values)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * _POW[base][0].upto(n)[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        back = _POW[self.base][1].upto(len(self.sums))
        return mix((self.sums[ends] - self.sums[starts]) * back[starts] + (ends - starts).astype(U) * U(0xA24BAED4963EE407))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most limit bytes of text, or one longer text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (rows + 1); null texts are empty."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row bounds of words [^\\x20\\x09-\\x0D]+; a word never crosses rows."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def normal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes with A-Z folded and one blank after each, and where each begins (words + 1)."""
    keep = np.zeros(len(data) + 1, bool)
    keep[:-1] = ~SPACE[data]
    sizes = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(int(at[-1]), 32, np.uint8)
    inner = np.ones(len(out), bool)
    inner[at[1:] - 1] = False
    out[inner] = _FOLD[data[keep[:-1]]]
    return out, at


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH3's 64 bits of each word with A-Z folded; each distinct word is hashed once."""
    text, at = normal(data, starts, ends)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(text)]).dictionary_encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, words.dictionary.to_pylist()), U, len(words.dictionary))
    return known[np.asarray(words.indices)]


def quick_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rolling hashes of the words with A-Z folded, for counts that may be slightly off."""
    return Rolling(_TABLE[_FOLD[data]], _R).of(starts, ends)


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k words in a row: each step mixes the next word into all bits of what came before."""
    n = max(0, len(words) - k + 1)
    out = words[:n].copy()
    for i in range(1, k):
        out = mix((out ^ (out >> U(31))) * _R + words[i : n + i])
    return out


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Per row, its sorted distinct k-word shingles; the whole sequence when shorter; none when empty."""
    whole = runs(words, k)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= k:
            yield unique(whole[lo : hi - k + 1])
        elif hi > lo:
            yield np.array([xxhash.xxh3_64_intdigest(words[lo:hi].tobytes(), hi - lo)], U)
        else:
            yield whole[:0]


def unique(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    return values[keep]


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column of the arrays."""
    ends = np.zeros(len(values) + 1, np.int32)
    ends[1:] = np.cumsum([len(v) for v in values])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64) if flat.dtype == U else flat, kind))
