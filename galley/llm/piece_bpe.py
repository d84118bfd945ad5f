"""Operator 10. SentencePiece BPE encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from galley.llm import common, segments, textkit

#: Symbols from here on are single characters that are no piece; they end as byte pieces.
CHAR = 1 << 20
WIDE = 1 << 22
NONE = np.int64(2**62)
BLANK = 0x2581
#: Bytes whose cuts are found together.
BLOCK = 4 << 20


class PieceModel:
    """Tables of a SentencePiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bos, self.eos = model.bos_id(), model.eos_id()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        text = {model.id_to_piece(i): i for i in normal}
        first_byte = next(i for i in range(n) if model.is_byte(i))
        self.byte = np.arange(first_byte, first_byte + 256)
        self.symbols = np.arange(0x110000, dtype=np.int64) + CHAR
        for piece, i in text.items():
            if len(piece) == 1:
                self.symbols[ord(piece)] = i
        order = {score: rank for rank, score in enumerate(sorted({model.get_score(i) for i in normal}, reverse=True))}
        rows = []
        for piece, i in text.items():
            for cut in range(1, len(piece)):
                left, right = (
                    text.get(part, int(self.symbols[ord(part)]) if len(part) == 1 else None) for part in (piece[:cut], piece[cut:])
                )
                if left is not None and right is not None:
                    rows.append((left * WIDE + right, order[model.get_score(i)], i))
        rows.sort()
        self.keys, self.ranks, self.made = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        self.lone = self._lone()
        inside = sorted({c for piece in text if len(piece) > 1 for c in piece})
        self.kinds, self.kind = len(inside) + 1, np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in inside]] = np.arange(1, len(inside) + 1)
        self.kind[0x20] = self.kind[BLANK]
        self.apart = np.ones(self.kinds**2, bool)  # pairs of kinds of characters that follow each other in no piece
        for piece in text:
            at = self.kind[[ord(c) for c in piece]]
            self.apart[at[:-1] * self.kinds + at[1:]] = False
        spelt = [b""] * n
        for i in normal:
            spelt[i] = model.id_to_piece(i).replace(chr(BLANK), " ").encode()
        for b, i in enumerate(self.byte):
            spelt[i] = bytes([b])
        self.spelt_sizes = np.array([len(x) for x in spelt], np.int64)
        self.spelt_starts = np.cumsum(self.spelt_sizes) - self.spelt_sizes
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE if it is no piece), and its row in the table."""
        key = left * WIDE + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), np.where(hit, at, -1)

    def _lone(self) -> np.ndarray:
        """Rows (a, b) -> m whose merge may be followed, beside it, by one of no greater rank: some (m, y) or (x, m)
        has such a rank though (b, y), or (x, a), has not. Merging several places at once could then differ from
        merging one after the other; for all other rows it cannot, as merges elsewhere do not touch their places."""
        left, right, lone = self.keys // WIDE, self.keys % WIDE, np.zeros(len(self.keys), bool)
        for side, order in ((left, np.arange(len(left))), (right, np.argsort(right, kind="stable"))):
            known = side[order]
            lo, hi = np.searchsorted(known, self.made, "left"), np.searchsorted(known, self.made, "right")
            row = np.repeat(np.arange(len(left)), hi - lo)
            more = order[segments.gather(np.arange(len(known)), lo, hi - lo)]
            better = self.ranks[more] <= self.ranks[row]
            row, more = row[better], more[better]
            now = self.pair(right[row], right[more])[0] if side is left else self.pair(left[more], left[row])[0]
            lone[row[now >= self.ranks[row]]] = True
        return lone

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of words: texts begin one, and so does a character that follows its predecessor in no piece, as no
        merge can join the two. Blanks, digits and most signs are parted so, and so are scripts without blanks."""
        first, lo, before = np.zeros(len(data) + 1, bool), 0, 0
        while lo < len(data):
            hi = min(len(data), lo + BLOCK)
            while hi < len(data) and data[hi] & 0xC0 == 0x80:
                hi += 1
            part = data[lo:hi]
            kind = self.kind.take(np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32))
            pairs = kind.copy()
            pairs[1:] += kind[:-1] * self.kinds
            pairs[0] += before * self.kinds
            first[lo:hi][(part & 0xC0) != 0x80] = self.apart.take(pairs)
            lo, before = hi, kind[-1]
        first[offsets[:-1]] = True
        return np.flatnonzero(first[:-1])

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = textkit.utf8(words)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        sizes = np.diff(heads[offsets])
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        chars[chars == 0x20] = BLANK
        word, symbol = self._merge(self.symbols[chars], np.repeat(np.arange(len(words)), sizes))
        char = np.where(symbol >= CHAR, symbol - CHAR, 0)
        n = np.where(symbol >= CHAR, 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF), 1)
        ids, at = np.repeat(symbol, n), np.cumsum(n) - n
        odd = np.flatnonzero(symbol >= CHAR)
        for size, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
            some = odd[n[odd] == size]
            for i in range(size):
                bits = char[some] >> (6 * (size - 1 - i))
                ids[at[some] + i] = self.byte[(bits | lead) if i == 0 else (bits & 0x3F) | 0x80]
        return ids.astype(np.uint32), np.bincount(word, n, len(words)).astype(np.int64)

    def _merge(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rounds: each word merges, at once, the leftmost of its pairs of least rank that do not overlap; words without
        a pair leave. Words that hold a `lone` pair of least rank twice leave too: they are merged pair by pair."""
        out_word, out_symbol = [], []
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank, row = np.full(len(symbol), NONE), np.full(len(symbol), -1)
        rank[inner], row[inner] = self.pair(symbol[inner], symbol[inner + 1])
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lengths = np.diff(np.concatenate([starts, [len(word)]]))
            least = np.minimum.reduceat(rank, starts)
            at = np.repeat(np.arange(len(starts)), lengths)
            best = np.flatnonzero((rank == least[at]) & (rank < NONE))
            places = np.bincount(at[best], minlength=len(starts))
            apart = np.zeros(len(starts), bool)
            apart[at[best[self.lone[row[best]]]]] = True
            apart &= places > 1
            for w in np.flatnonzero(apart).tolist():
                done = self._one_by_one(symbol[starts[w] : starts[w] + lengths[w]].tolist())
                out_symbol.append(np.array(done, np.int64))
                out_word.append(np.full(len(done), word[starts[w]]))
            gone = apart | (places == 0)
            if gone.any():
                over = np.repeat((places == 0) & ~apart, lengths)
                out_word.append(word[over])
                out_symbol.append(symbol[over])
                stay = np.repeat(~gone, lengths)
                moved = np.cumsum(stay) - 1
                best = moved[best[stay[best]]]
                word, symbol, rank, row = word[stay], symbol[stay], rank[stay], row[stay]
                if not len(word):
                    break
            # Of places that follow each other, every other one, from the left of the run.
            first = np.concatenate([[True], np.diff(best) > 1])
            run = np.arange(len(best)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            best = best[run % 2 == 0]
            symbol[best] = self.made[row[best]]
            keep = np.ones(len(symbol), bool)
            keep[best + 1] = False
            at = best - np.arange(len(best))
            word, symbol, rank, row = word[keep], symbol[keep], rank[keep], row[keep]
            again = np.unique(np.concatenate([at, at[at > 0] - 1]))
            right = np.minimum(again + 1, len(symbol) - 1)
            joined = (right > again) & (word[again] == word[right])
            rank[again], row[again] = NONE, -1
            again, right = again[joined], right[joined]
            rank[again], row[again] = self.pair(symbol[again], symbol[right])
        word, symbol = np.concatenate(out_word or [word]), np.concatenate(out_symbol or [symbol])
        order = np.argsort(word, kind="stable")
        return word[order], symbol[order]

    def _one_by_one(self, symbols: list[int]) -> list[int]:
        """The merges of one word whose order between places matters, as in runs of blanks."""
        flat = np.array(symbols, np.int64)
        ranks, _ = self.pair(flat[:-1], flat[1:])
        heap = [(r, i, symbols[i], symbols[i + 1]) for i, r in enumerate(ranks.tolist()) if r < NONE]
        heapq.heapify(heap)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))

        def push(i: int) -> None:
            if i >= 0 and after[i] < len(symbols):
                r, _ = self._one(symbols[i], symbols[after[i]])
                if r < NONE:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[after[i]]))

        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if symbols[i] == left else len(symbols)
            if j >= len(symbols) or symbols[j] != right:
                continue
            symbols[i], symbols[j] = self._one(left, right)[1], -1
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            push(before[i])
            push(i)
        return [s for s in symbols if s >= 0]

    def _one(self, left: int, right: int) -> tuple[int, int]:
        return self._table.get(left * WIDE + right, (int(NONE), -1))

    @cached_property
    def _table(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))

    def coder(self) -> segments.SegmentCoder:
        return segments.SegmentCoder(self.cuts, self._encode)

    def encode(self, texts: pa.Array, coder: segments.SegmentCoder | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with begin and end ids, and the bounds of each. Null texts are empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        full = pc.greater(pc.binary_length(texts), 0)
        led = pc.if_else(full, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())), texts)
        ids, bounds = (coder or self.coder()).ids(led)
        n = np.diff(bounds)
        ends = np.cumsum(n + 2)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        out[ends - 1], out[ends - n - 2] = self.eos, self.bos
        out[np.arange(len(ids)) + np.repeat(2 * np.arange(len(n)) + 1, n)] = ids
        return out, np.concatenate([[0], ends])

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """UTF-8 of each run of ids: control ids are silent, the blank put before a text goes, bad bytes become U+FFFD."""
        sizes = self.spelt_sizes[ids]
        spelt = segments.gather(self.spelt, self.spelt_starts[ids], sizes).tobytes()
        at = np.concatenate([[0], np.cumsum(sizes)])[bounds].tolist()
        out = []
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            text = spelt[lo + 1 : hi] if spelt[lo : lo + 1] == b" " and hi > lo else spelt[lo:hi]
            try:
                text.decode()
            except UnicodeDecodeError:
                text = text.decode(errors="replace").encode()
            out.append(text)
        return out


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, ids): the ids of every whole text, begin and end ids included. A null text is empty: two ids. Rows that share
    an id, or have none, are each a row; texts may be of any length; other columns are ignored; an empty table gives no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(path).coder()
        for unit in segments.units(batches):
            ids, bounds = model(path).encode(unit.column("text"), coder)
            yield pa.RecordBatch.from_arrays(
                [unit.column("id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32)))], ["id", "ids"]
            )

    return docs.selectExpr(f"`{id_col}` id", f"`{text_col}` text").mapInArrow(run, "id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(id, text) of (id, ids). Null and empty ids give an empty text; each row is decoded by itself; other columns are
    ignored; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pc.fill_null(batch.column("ids"), pa.scalar([], pa.list_(pa.int32())))
            bounds = np.asarray(ids.offsets).astype(np.int64)
            flat = np.asarray(ids.values)[bounds[0] : bounds[-1]]
            text = model(path).decode(flat, bounds - bounds[0])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([t.decode() for t in text], pa.string())], ["id", "text"])

    return coded.select("id", "ids").mapInArrow(run, "id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded again. A null or empty text
    is two ids and an empty text; rows that share an id, or have none, are each a row; long texts are never cut; other
    columns are ignored; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(path).coder()
        for unit in segments.units(batches):
            ids, bounds = model(path).encode(unit.column("text"), coder)
            raw, at = ids.astype("<u4").tobytes(), (bounds * 4).tolist()
            coded = [hashlib.sha256(raw[lo:hi]).hexdigest() for lo, hi in zip(at[:-1], at[1:], strict=True)]
            text = [hashlib.sha256(t).hexdigest() for t in model(path).decode(ids, bounds)]
            yield pa.RecordBatch.from_arrays(
                [unit.column("doc_id"), pa.array(np.diff(bounds)), pa.array(coded), pa.array(text)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document and its text read back, as digests."""
    import public_tokenizers

    return digests(common.read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
