"""Operator 12. Language-model scores: the probability of a text over all its segmentations into pieces of a vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm import common, textkit

#: Parameters of the model. Groups with most training texts that get weights of their own, the others share one set;
#: rounds of re-estimation; expected pieces that the vocabulary's own scores count for; what is taken from each word's
#: count for words that are spelt.
GROUPS, ROUNDS, STRENGTH, DISCOUNT = 8, 4, 500.0, 0.75
#: Most frequent words, of at most SHORT bytes, whose figures all tasks hold, of those that are one in SHARE tokens at least;
#: figures of the others are joined. Speed only.
FREQUENT, SHORT, SHARE = 65_536, 64, 2**20
#: Cells of a lattice worked on at once. Memory only.
CELLS = 1 << 21
_LOW = -1e30


class Vocabulary:
    """Pieces of a sentencepiece model that can spell words in lower case, as a tree of bytes, and their own scores.

    A word is spelt with a blank before it. Each byte is a piece of its own as well, so that any word can be spelt. A
    unigram model's scores are logarithms of weights; a BPE model's are ranks of merges, taken to weigh 1 / (rank + 1).
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        spelt, scores = [], []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) and b" " not in piece[1:] and piece.lower() == piece:
                spelt.append(piece)
                scores.append(model.get_score(i))
        scores = np.array(scores)
        ranked = bool((scores == np.round(scores)).all())
        own = -np.log(np.maximum(1.0, 1.0 - scores)) if ranked else scores
        # Single bytes come first, then the pieces; the last number stands for no piece.
        prior = np.concatenate([np.full(256, own.min(initial=0.0)), own])
        self.prior = prior - np.logaddexp.reduce(prior)
        self.size = len(prior)
        tree: dict[tuple[int, int], int] = {}
        ends = {}
        for n, piece in enumerate(spelt):
            node = 0
            for b in piece:
                node = tree.setdefault((node, b), len(tree) + 1)
            ends[node] = 256 + n
        keys = np.array([a * 256 + b for a, b in tree], np.int64)
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.array(list(tree.values()), np.int64)[order]
        self.piece = np.full(len(tree) + 1, self.size, np.int32)
        self.piece[list(ends)] = list(ends.values())

    def arcs(self, words: np.ndarray) -> list[np.ndarray]:
        """Of words of one length, as columns of bytes with their blank: for each number of bytes d, the pieces [start,
        word] of d bytes, size where there is none."""
        length, n = words.shape
        flat = words.astype(np.int64).ravel()
        out = [words.astype(np.int32)]
        at, node = np.arange(length * n), np.zeros(length * n, np.int64)
        for d in range(1, length + 1):
            here = at < (length - d + 1) * n
            at, node = at[here], node[here]
            key = node * 256 + flat[at + (d - 1) * n]
            row = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[row] == key
            at, node = at[hit], self.child[row[hit]]
            if not len(at):
                break
            found = np.full((length - d + 1) * n, self.size, np.int32)
            found[at] = self.piece[node]
            out.append(found.reshape(-1, n))
        # A byte is spelt by itself and, where the vocabulary has it, by a piece of one byte.
        return out


def _spans(arcs: list[np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """(bytes, pieces): the single bytes and the pieces of one byte both span one."""
    return [(max(1, d), a) for d, a in enumerate(arcs)]


def _sum(parts: list[np.ndarray]) -> np.ndarray:
    """Logarithm of the sum of exponentials."""
    most = np.maximum.reduce(parts)
    return most + np.log(sum(np.exp(p - most) for p in parts))


def forward(arcs: list[np.ndarray], weights: np.ndarray, length: int) -> np.ndarray:
    """Log probability [place, set, word] of all ways to spell the bytes before each place; weights [set, piece + 1]."""
    alpha = np.empty((length + 1, len(weights), arcs[0].shape[1]), weights.dtype)
    alpha[0] = 0.0
    spans = _spans(arcs)
    for t in range(1, length + 1):
        alpha[t] = _sum([alpha[t - d] + weights[:, a[t - d]] for d, a in spans if d <= t])
    return alpha


def expected(arcs: list[np.ndarray], weights: np.ndarray, length: int, counts: np.ndarray, size: int) -> np.ndarray:
    """Expected number of each piece in the words, each counted so many times; weights [word, ...] are one set."""
    alpha = forward(arcs, weights[None], length)[:, 0]
    beta = np.zeros_like(alpha)
    spans = _spans(arcs)
    for t in range(length - 1, -1, -1):
        beta[t] = _sum([weights[a[t]] + beta[t + d] for d, a in spans if t + d <= length])
    out = np.zeros(size + 1)
    for d, a in spans:
        where = np.flatnonzero(a.ravel() < size)
        start, word = np.divmod(where, a.shape[1])
        piece = a.ravel()[where]
        share = np.exp(alpha[start, word] + weights[piece] + beta[start + d, word] - alpha[length, word])
        out += np.bincount(piece, share * counts[word], size + 1)
    return out[:size]


def by_size(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns of bytes with a blank before): words of one length, not too many at once."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    starts = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for lo, hi in zip(starts, [*starts[1:], len(order)], strict=True):
        length = int(sizes[order[lo]])
        step = max(1, CELLS // (16 * length))
        for at in range(lo, hi, step):
            rows = order[at : min(hi, at + step)]
            data = np.frombuffer(b"".join(b" " + words[r] for r in rows.tolist()), np.uint8)
            yield rows, np.ascontiguousarray(data.reshape(len(rows), length).T)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(batch, words, word of each token, bounds of the rows' tokens), about a megabyte at a time."""
    for whole in batches:
        for batch in textkit.slices(whole, limit=1 << 20):
            data, offsets = textkit.utf8(batch.column("text"))
            starts, ends, bounds = textkit.word_spans(data, offsets)
            text, at = textkit.normal(data, starts, ends)
            coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(text)]).dictionary_encode()
            yield batch, [w[:-1] for w in coded.dictionary.to_pylist()], np.asarray(coded.indices), bounds


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, grp, n): occurrences of each word in the training texts of a group, and in the others, group -1."""
    for batch, words, token, bounds in _texts(batches):
        owner = np.repeat(np.asarray(batch.column("grp")), np.diff(bounds)).astype(np.int64)
        key, n = np.unique((owner + 1) * max(1, len(words)) + token, return_counts=True)
        group, word = np.divmod(key, max(1, len(words)))
        yield pa.RecordBatch.from_arrays([pa.array([words[w] for w in word.tolist()], pa.binary()), pa.array(group - 1), pa.array(n)], ["word", "grp", "n"])


def _expected(vocabulary, weights):
    """(grp, piece, n): expected pieces of what a task's words leave over for spelling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = vocabulary.value, weights.value.astype(np.float32)
        total = np.zeros((len(w), v.size))
        for batch in batches:
            counts = np.minimum(DISCOUNT, np.stack([np.asarray(batch.column(f"c{g}")) for g in range(len(w))], 1))
            words = batch.column("word").to_pylist()
            for rows, columns in by_size(words):
                arcs = v.arcs(columns)
                for g in range(len(w)):
                    some = np.flatnonzero(counts[rows, g])
                    if len(some):
                        total[g] += expected([a[:, some] for a in arcs], w[g], len(columns), counts[rows[some], g], v.size)
        group, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(piece), pa.array(total[group, piece])], ["grp", "piece", "n"])

    return run


def _spelt(vocabulary, weights, tokens: np.ndarray, left: np.ndarray):
    """(word, c, n, logs): each word's log probability in each group, as a whole and spelt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = vocabulary.value, weights.value
        for batch in batches:
            logs = np.zeros((batch.num_rows, len(w)))
            for rows, columns in by_size(batch.column("word").to_pylist()):
                logs[rows] = forward(v.arcs(columns), w, len(columns))[-1].T
            counts = np.stack([np.asarray(batch.column(f"c{g}")) for g in range(len(w))], 1)
            with np.errstate(divide="ignore"):
                logs = np.logaddexp(np.log(np.maximum(0, counts - DISCOUNT) / tokens), np.log(left) + logs)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(w)), pa.array(logs.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), batch.column("n"), lists], ["word", "c", "n", "logs"])

    return run


def _parts(table, sets: int):
    """Of each row, (row, doc_id, held, tokens, known, base, logs) summed over its frequent words; and (row, word, n) for
    each of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, c, logs = table.value
        c = np.append(c, 0)
        figures = [*np.append(logs, np.zeros((1, sets)), 0).T, (c > 0).astype(float), np.where(np.arange(len(c)) < len(c) - 1, np.log10(c + 0.1), 0.0)]
        base = TaskContext.get().partitionId() << 40
        for batch, words, token, bounds in _texts(batches):
            at = np.array([place.get(w, len(place)) for w in words], np.int64)[token] if len(words) else np.zeros(0, np.int64)
            rows = batch.num_rows
            owner = np.repeat(np.arange(rows), np.diff(bounds))
            sums = [np.bincount(owner, f[at], rows).astype(float) for f in figures]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * sets), pa.array(np.stack(sums[:sets], 1).ravel()))
            tokens = pa.array(np.diff(bounds).astype(np.int64))
            whole = [pa.array(base + np.arange(rows)), batch.column("doc_id"), batch.column("held"), tokens, pa.nulls(rows, pa.binary()), pa.array(sums[sets].astype(np.int64)), pa.array(sums[sets + 1]), lists]
            names = ["row", "doc_id", "held", "n", "word", "known", "base", "logs"]
            yield pa.RecordBatch.from_arrays(whole, names)
            rare = np.flatnonzero(at == len(place))
            key, n = np.unique(owner[rare] * max(1, len(words)) + token[rare], return_counts=True)
            row, word = np.divmod(key, max(1, len(words)))
            none = lambda kind: pa.nulls(len(key), kind)
            some = [pa.array(base + row), none(pa.int64()), none(pa.bool_()), pa.array(n), pa.array([words[w] for w in word.tolist()], pa.binary()), none(pa.int64()), none(pa.float64()), none(lists.type)]
            yield pa.RecordBatch.from_arrays(some, names)
            base += rows

    return run


def held_out(column: str) -> Column:
    """Texts that are not learnt from: crc32 of the id as text, modulo 10, is 0; a null id is as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def lm_scores(docs: DataFrame, model: str, group_col: str | None = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    The base is a unigram model of words in lower case, smoothed by 0.1, each text closed by an end. score is the log10
    probability of the text's words and end, over all segmentations: a word is one arc, if it was learnt, and every way
    to spell it by pieces of the vocabulary is a path, summed by forward recursion in logarithms. The vocabulary's own
    scores are where the pieces' weights start, and count for STRENGTH pieces; ROUNDS times, each piece's expected number
    in the training words gives new ones. DISCOUNT of each word's count is left for spelling, and it is what pieces are
    learnt from, so that they fit words that are seldom or never seen. Groups of training texts (by group_col; a null is a
    group) have counts and weights of their own: a text's probability is the sum over groups of the group's share times
    the probability in it, so that scoring reads the text alone. The probabilities of all texts sum to one at most.
    Without training texts the vocabulary's scores are the weights.

    A null or empty text is an end alone. Rows that share an id count and are scored each; a null id is held out. A word
    of any length is spelt whole, in time and memory in proportion. Other columns are ignored; an empty table gives no
    rows. Counts cover all training texts: words are counted where they are read, then by word; the expected pieces
    of a task are as many as the vocabulary has. Figures of frequent words go to every task, so that no key that is
    joined is in many rows; those of other words are joined by word.
    """
    spark = docs.sparkSession
    group = F.col(f"`{group_col}`").cast("string") if group_col else F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), held_out(f"`{id_col}`").alias("held"), group.alias("label"))
    many = rows.where("NOT held").groupBy("label").count().orderBy(F.desc("count"), "label").limit(GROUPS).collect()
    total = rows.where("NOT held").count()
    texts = np.array([r["count"] for r in many] + [total - sum(r["count"] for r in many)], np.int64)
    texts = texts[: len(texts) - (texts[-1] == 0 and len(texts) > 1)]
    sets = len(texts)
    place = F.lit(sets - 1)
    for g, r in enumerate(many):
        place = F.when(F.col("label").eqNullSafe(F.lit(r["label"])), F.lit(g)).otherwise(place)
    rows = rows.withColumn("grp", F.when(F.col("held"), F.lit(-1)).otherwise(place).cast("int"))

    counted = rows.select("grp", "text").mapInArrow(_counts, "word binary, grp long, n long")
    each = [F.sum(F.when(F.col("grp") == g, F.col("n")).otherwise(0)).alias(f"c{g}") for g in range(sets)]
    words = counted.groupBy("word").agg(F.sum("n").alias("n"), *each).withColumn("c", sum((F.col(f"c{g}") for g in range(sets)), F.lit(0)))
    words = common.materialize(words.sortWithinPartitions(F.length("word")), "words")
    figures = [f(c).alias(f"{n}{g}") for g in range(sets) for c, f, n in ((F.col(f"c{g}"), F.sum, "t"), (F.least(F.col(f"c{g}"), F.lit(DISCOUNT)), F.sum, "d"))]
    learnt = words.agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v"), *figures).first()
    train, kinds = (learnt["c"] or 0) + total, learnt["v"] + (total > 0)
    # Half a token each for the end and for spelling, so that neither is impossible in a group.
    tokens = np.array([(learnt[f"t{g}"] or 0) + int(texts[g]) + 1.0 for g in range(sets)])
    left = np.array([(learnt[f"d{g}"] or 0) + 0.5 for g in range(sets)]) / tokens
    end = np.log((texts + 0.5) / tokens)

    vocabulary = Vocabulary(model)
    shared = spark.sparkContext.broadcast(vocabulary)
    pad = lambda w: np.concatenate([w, np.full((sets, 1), _LOW)], 1)
    weights = pad(np.repeat(vocabulary.prior[None], sets, 0))
    for _ in range(ROUNDS if total else 0):
        parts = words.where("c > 0").mapInArrow(_expected(shared, spark.sparkContext.broadcast(weights)), "grp long, piece long, n double")
        found = parts.groupBy("grp", "piece").agg(F.sum("n").alias("n")).toArrow()
        seen = np.zeros((sets, vocabulary.size))
        seen[np.asarray(found["grp"]), np.asarray(found["piece"])] = np.asarray(found["n"])
        seen += STRENGTH * np.exp(vocabulary.prior)
        weights = pad(np.log(seen / seen.sum(1, keepdims=True)))
    spelt = common.materialize(words.mapInArrow(_spelt(shared, spark.sparkContext.broadcast(weights), tokens, left), "word binary, c long, n long, logs array<double>"), "spelt")
    common.release(words)

    top = spelt.where((F.length("word") <= SHORT) & (F.col("n") * SHARE >= (learnt["n"] or 0))).orderBy(F.desc("n"), "word").limit(FREQUENT).select("word", "c", "logs").toArrow()
    logs = np.asarray(top["logs"].combine_chunks().flatten()).reshape(-1, sets)
    table = spark.sparkContext.broadcast(({w: i for i, w in enumerate(top["word"].to_pylist())}, np.asarray(top["c"]), logs))
    schema = "row long, doc_id long, held boolean, n long, word binary, known long, base double, logs array<double>"
    parts = common.materialize(rows.select("doc_id", "held", "text").mapInArrow(_parts(table, sets), schema), "parts")
    log = [F.get("logs", g).alias(f"l{g}") for g in range(sets)]
    figures = ["tokens", "known", "base", *(f"l{g}" for g in range(sets))]
    whole = parts.where("word IS NULL").select("row", "doc_id", "held", F.col("n").alias("tokens"), "known", "base", *log)
    rare = parts.where("word IS NOT NULL").select("row", "word", F.col("n").alias("times")).join(common.large(spelt), "word")
    of = [F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("known"), (F.col("times") * F.log10(F.col("c") + 0.1)).alias("base")]
    of += [(F.col("times") * F.get("logs", g)).alias(f"l{g}") for g in range(sets)]
    rare = rare.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held"), F.lit(0).cast("long").alias("tokens"), *of)
    summed = whole.unionByName(rare).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held").alias("held"), *[F.sum(c).alias(c) for c in figures])

    share = np.log(np.maximum(texts, 1e-300) / max(1, texts.sum())) if total else np.zeros(sets)
    ways = F.array(*[F.col(f"l{g}") + F.lit(float(end[g] + share[g])) for g in range(sets)])
    most = F.array_max("ways")
    score = (most + F.ln(F.aggregate("ways", F.lit(0.0), lambda s, x: s + F.exp(x - most)))) / float(np.log(10))
    n_tokens = (F.col("tokens") + 1).cast("long")
    base = F.col("base") + float(np.log10(total + 0.1)) - n_tokens * float(np.log10(train + 0.1 * (kinds + 1)))
    return summed.withColumn("ways", ways).select(
        "doc_id", F.col("held").alias("held_out"), n_tokens.alias("n_tokens"), (F.col("known") + int(total > 0)).cast("long").alias("n_known"),
        F.lit(int(train)).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"),
    )


def op12_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    import public_tokenizers

    return lm_scores(common.read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
