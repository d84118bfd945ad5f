"""Operator 13. Periodic runs of words: a harmonic grid of (period, place) pairs, extended by prefix hashes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import common, textkit

#: A run has at least so many words.
LEAST = 12
#: Bytes of a text split into words at once, and pairs of the grid extended at once. Memory only.
PART, PAIRS = 4 << 20, 1 << 20
_M = np.int64(2**31 - 1)


class Prefixes:
    """Hashes of the starts of a sequence, modulo a prime, with a base drawn anew for each attempt. Equal hashes may
    deceive, so what they say is compared word by word later; unequal ones never do."""

    def __init__(self, ids: np.ndarray, attempt: int) -> None:
        rnd = np.random.default_rng([20_241, attempt])
        base = np.int64(rnd.integers(2**20, _M - 1))
        self.powers = np.ones(1, np.int64)
        while len(self.powers) <= len(ids):
            self.powers = np.concatenate([self.powers, self.powers * (self.powers[-1] * base % _M) % _M])
        values = textkit.mix(ids.astype(np.uint64) * np.uint64(2) + np.uint64(rnd.integers(1, 2**63)))
        values = (values >> np.uint64(33)).astype(np.int64) % _M
        self.sums = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(values * self.powers[: len(ids)] % _M, out=self.sums[1:])
        self.sums %= _M

    def equal(self, a: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n words from a seem to be those from a + p."""
        first = (self.sums[a + n] - self.sums[a]) % _M * self.powers[p] % _M
        return first == (self.sums[a + p + n] - self.sums[a + p]) % _M


def _reach(test: Callable[[np.ndarray], np.ndarray], most: np.ndarray) -> np.ndarray:
    """For all pairs at once, by halving: the length at which test holds, as it does for 0, and not one further."""
    lo, hi = np.zeros_like(most), most.copy()
    while (lo < hi).any():
        mid = (lo + hi + 1) >> 1
        good = test(mid)
        lo, hi = np.where(good, mid, lo), np.where(good, hi, mid - 1)
    return lo


def _extended(a: np.ndarray, p: np.ndarray, hashes: Prefixes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of the stretches around places a and a + p of equal words, as far as words p apart
    agree, of at least two periods. lo and hi are the bounds of each place's text."""
    room, back = hi[a + p] - (a + p), a - lo[a]
    half = (p + 1) >> 1  # of the p equal words that two periods need, half lie on one side of a
    ahead, behind = np.where(room >= half, half, 0), np.where(back >= half, half, 0)
    keep = (ahead > 0) & hashes.equal(a, p, ahead) | (behind > 0) & hashes.equal(a - behind, p, behind)
    a, p, room, back = a[keep], p[keep], room[keep], back[keep]
    ahead = _reach(lambda n: hashes.equal(a, p, n), room)
    behind = _reach(lambda n: hashes.equal(a - n, p, n), back)
    rows = np.stack([a - behind, a + p + ahead, p], 1)
    return rows[rows[:, 1] - rows[:, 0] >= np.maximum(LEAST, 2 * p)]


def _attempt(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, longest: int, attempt: int) -> np.ndarray | None:
    hashes = Prefixes(ids, attempt)
    found, held, count = [np.zeros((0, 3), np.int64)], [], 0

    def flush() -> None:
        nonlocal held, count
        if held:
            a, p = np.concatenate([x for x, _ in held]), np.repeat([q for _, q in held], [len(x) for x, _ in held])
            found.append(np.unique(_extended(a, p, hashes, lo, hi), axis=0))
        held, count = [], 0

    for p in range(1, longest // 2 + 1):
        grid = ids[::p]
        at = np.flatnonzero(grid[1:] == grid[:-1]) * p
        for part in np.array_split(at, len(at) // PAIRS + 1):
            if len(part):
                held.append((part, p))
                count += len(part)
            if count >= PAIRS:
                flush()
    flush()
    rows = np.unique(np.concatenate(found), axis=0)
    # A stretch is found with each multiple of its period that fits twice: the least is the period.
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    least = rows[np.flatnonzero(new)[np.cumsum(new) - 1], 2] if len(rows) else rows[:, 2]
    if (rows[:, 2] % least).any():
        return None
    rows = rows[new]
    for s, e, p in rows.tolist():
        if not np.array_equal(ids[s : e - p], ids[s + p : e]):
            return None
    return rows


def runs(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Per sequence of word numbers, its runs as rows (start, length, period), by start and period.

    A run is a stretch with smallest period q of at least max(LEAST, 2 * q) words that cannot be made longer. For each
    period p every p-th place is a grid point; a run of two periods holds two neighbouring ones, whose words agree.
    The words that agree before and after them, all pairs at once, give the run. Sequences of like length are laid end
    to end, parted by numbers that occur once. What hashes say is compared word by word; if they deceived, another
    base is drawn.
    """
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    classes = np.frexp(sizes.astype(float))[1]
    for c in np.unique(classes[sizes >= LEAST]).tolist():
        rows = np.flatnonzero((classes == c) & (sizes >= LEAST))
        starts = np.concatenate([[0], np.cumsum(sizes[rows] + 1)])
        whole = np.empty(int(starts[-1]), np.int64)
        for n, r in enumerate(rows.tolist()):
            whole[starts[n] : starts[n + 1] - 1] = texts[r]
            whole[starts[n + 1] - 1] = -1 - n
        lo, hi = np.repeat(starts[:-1], np.diff(starts)), np.repeat(starts[1:] - 1, np.diff(starts))
        attempt = 0
        while (found := _attempt(whole, lo, hi, int(sizes[rows].max()), attempt)) is None:
            attempt += 1
        owner = np.searchsorted(starts, found[:, 0], "right") - 1
        bounds = np.searchsorted(owner, np.arange(len(rows) + 1))
        for n, r in enumerate(rows.tolist()):
            mine = found[bounds[n] : bounds[n + 1]]
            mine = np.stack([mine[:, 0] - starts[n], mine[:, 1] - mine[:, 0], mine[:, 2]], 1)
            out[r] = mine[np.lexsort((mine[:, 2], mine[:, 0]))]
    return out


def word_ids(text: bytes, table: dict[bytes, int]) -> np.ndarray:
    """Numbers of the words [^\\x20\\x09-\\x0D]+, which bytes.split() parts at the same signs; new ones join the table."""
    parts, at = [np.zeros(0, np.int64)], 0
    while at < len(text):
        end = min(len(text), at + PART)
        while end < len(text) and not textkit.SPACE[text[end]]:
            end += 1
        parts.append(np.array([table.setdefault(w, len(table)) for w in text[at:end].split()], np.int64))
        at = end
    return np.concatenate(parts)


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run holds beyond its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edges)[:n] == 0


def joined_sha256(ids: np.ndarray, words: list[bytes]) -> str:
    """Of the words joined by one space, a few at a time."""
    digest = hashlib.sha256()
    for at in range(0, len(ids), 1 << 16):
        digest.update(b" " * (at > 0) + b" ".join(map(words.__getitem__, ids[at : at + (1 << 16)].tolist())))
    return digest.hexdigest()


RUNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>"


def _document(doc_id: int | None, ids: np.ndarray, found: np.ndarray, words: list[bytes]) -> dict:
    best = min(found.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=None)
    listing = "".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())
    return {
        "doc_id": doc_id, "n_runs": len(found), "start": best and best[0], "length": best and best[1], "period": best and best[2],
        "exponent_milli": best and 1000 * best[1] // best[2], "runs_sha256": hashlib.sha256(listing.encode()).hexdigest(),
        "collapsed_sha256": joined_sha256(ids[kept(len(ids), found)], words), "runs": [{"start": s, "length": n, "period": p} for s, n, p in found.tolist()],
    }


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[int | None, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Per row its runs of repeated words: (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256, runs).

    A run is as in runs(); start, length, period and exponent are those of the longest, of least start and then period
    where several are, and null without a run. collapsed_sha256 is of the words that stay when every run keeps its
    first period only, joined by one space. `change` may rewrite a row's word numbers before the search. A null or
    empty text has no words; rows that share an id are searched each by itself; a text may be of any length, and takes
    memory for its word numbers; other columns are ignored; an empty table gives no rows. There is no shuffle.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema(_ARROW)
        for whole in batches:
            for batch in textkit.slices(whole):
                table: dict[bytes, int] = {}
                ids = batch.column("doc_id").to_pylist()
                texts = [word_ids(t.as_buffer().to_pybytes() if t.is_valid else b"", table) for t in batch.column("text").cast(pa.large_binary())]
                if change:
                    texts = [change(i, t) for i, t in zip(ids, texts, strict=True)]
                words = list(table)
                found = runs(texts)
                yield pa.RecordBatch.from_pylist([_document(i, t, f, words) for i, t, f in zip(ids, texts, found, strict=True)], out)

    return rows.mapInArrow(run, RUNS)


_ARROW = [
    ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
    ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
]


def planted(doc_id: int | None, ids: np.ndarray) -> np.ndarray:
    """The query's rewriting: in one row of ten, by the id's checksum, all words from a place on repeat with a period."""
    if doc_id is None or not len(ids):
        return ids
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(ids)
    if h % 10:
        return ids
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([ids[:a], np.resize(ids[a : a + p], n - a)])


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents."""
    return periodic_runs(common.read(spark, sf_dir, "documents"), change=planted).drop("runs")
