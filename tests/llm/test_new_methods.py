"""Operators 11 to 13 against brute force, with small blocks, and with odd rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from galley.llm import lattice, negatives, periodic
from public_tokenizers import path

VECTORS = "vec_id long, embedding array<float>, label int, score string"


@pytest.mark.parametrize(("rows", "anchors", "scale"), [(4, 3, 256), (4096, 512, 256), (8, 8, 2**27)])
def test_hard_negatives(spark, rows, anchors, scale):
    rnd = np.random.default_rng(4)
    x = np.concatenate([rnd.normal(size=(40, 6)) + 1, np.full((6, 6), 0.5), np.zeros((2, 6))]).astype(np.float32)
    data = [(i, v.tolist(), [0, 0, 1, 2][i % 4], "clash") for i, v in enumerate(x)]
    data += [(60, None, 1, "a"), (61, [1.0, None], 1, "a"), (62, [float("nan")] * 6, 1, "a"), (63, [1.0] * 6, None, "a"), (None, [1.0] * 6, 1, "a"), (64, [1.0, 2.0], 1, "short"), (66, [2.0, 2.0], 1, "short"), (68, [0.5, 1.5], 0, "short"), (69, [], 0, "empty")]
    data += [data[5], (3, [1.0] * 6, 2, "again")]
    frame = spark.createDataFrame(data, VECTORS).repartition(3)
    got = negatives.hard_negatives(frame, F.col("vec_id") % 2 == 0, positives=3, negatives=4, low=30, high=90, scale=scale, rows=rows, anchors=anchors).collect()
    good = [(i, [int(np.floor(float(np.float32(c)) * scale)) for c in v], y) for i, v, y, _ in data if i is not None and y is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    expected = []
    for i, v, y in good:
        if i % 2:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, w, z in good if j != i and len(w) == len(v))
        for p, j, _ in [s for s in scores if s[2] == y][:3]:
            found = [(j2, -s) for s, j2, z in scores if z != y and 30 * -p <= 100 * -s <= 90 * -p][:4]
            expected += [(i, j, n + 1, j2, -p, s) for n, (j2, s) in enumerate(found)]
    assert sorted(map(tuple, got)) == sorted(expected)
    assert len(expected) > 50 and any(r[0] == 64 for r in expected)
    assert negatives.hard_negatives(frame.limit(0), F.col("vec_id") % 2 == 0).collect() == []


def all_runs(w):
    """Every stretch, tried as the definition says."""
    out = []
    for s in range(len(w)):
        for e in range(s + 12, len(w) + 1):
            q = next(q for q in range(1, e - s + 1) if w[s : e - q] == w[s + q : e])
            if 2 * q <= e - s and not (s and w[s - 1] == w[s - 1 + q]) and not (e < len(w) and w[e] == w[e - q]):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(n):
    rnd = np.random.default_rng(n)
    word = lambda: "ab cd ef gh ij".split()[rnd.integers(0, 1 + n % 5)]
    size = int(rnd.integers(0, 70))
    words = [word() for _ in range(size)]
    if n % 3 == 0:
        p = 1 + int(rnd.integers(0, 9))
        words = [words[i % p] if i > 4 else w for i, w in enumerate(words)] + [word() for _ in range(5)]
    return rnd.choice([" ", "\n", "\t \x0b"]).join(words)


def test_periodic_runs_of_every_shape(spark):
    a, b = "x", "y"
    for _ in range(6):
        a, b = a + b, b + a
    texts = {i: made(i) for i in range(120)} | {200: None, 201: "", 202: " \n ", 203: " word " * 12, 204: " ".join(a), 205: " ".join("abaababaabaab" * 3), 206: "w " * 11, 207: "é é " * 13}
    rows = [(i, t, "clash") for i, t in texts.items()] + [(7, texts[3], "again"), (None, "z " * 40, "no id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    got = periodic.periodic_runs(frame, change=periodic.planted).collect()
    expected = []
    for i, t, _ in rows:
        words = (t or "").encode().split()
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and words:
            at, g = h // 10 % len(words), h // 10
            p = 1 + (len(words) - at) // (3 + g % 8)
            words = [words[at + (j - at) % p] if j >= at else w for j, w in enumerate(words)]
        found = all_runs(words)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        stay = [w for j, w in enumerate(words) if not any(s + q <= j < s + n for s, n, q in found)]
        told = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
        expected.append((i, len(found), *(best[:1] + best[1:] if best else (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(told).hexdigest(), hashlib.sha256(b" ".join(stay)).hexdigest()))
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r)[:8] for r in got), key=str) == sorted(expected, key=str)
    assert sum(r[1] for r in expected) > 20
    assert periodic.periodic_runs(frame.limit(0)).collect() == []


def test_runs_survive_hashes_that_deceive(monkeypatch):
    rnd = np.random.default_rng(3)
    texts = [np.resize(rnd.integers(0, 3, int(rnd.integers(1, 12))), int(rnd.integers(12, 90))) for _ in range(20)] + [rnd.integers(0, 2, 200) for _ in range(3)]
    right, drawn = periodic.runs(texts), []

    class Weak(periodic.Prefixes):
        def __init__(self, ids, attempt):
            drawn.append(attempt)
            super().__init__(ids, attempt)
            if attempt < 2:
                self.sums %= 3

        def equal(self, a, p, n):
            first = (self.sums[a + n] - self.sums[a]) * self.powers[p]
            return super().equal(a, p, n) | (first % 3 == (self.sums[a + p + n] - self.sums[a + p]) % 3) if drawn[-1] < 2 else super().equal(a, p, n)

    monkeypatch.setattr(periodic, "Prefixes", Weak)
    assert all(np.array_equal(x, y) for x, y in zip(periodic.runs(texts), right, strict=True))
    assert 1 in drawn


def test_long_periods_and_long_texts():
    rnd = np.random.default_rng(8)
    half = rnd.integers(0, 50_000, 30_000)
    text = np.concatenate([[60_001], half, half, half[:5], [60_002], np.full(20_000, 7)])
    assert periodic.runs([text])[0].tolist() == [[1, 60_005, 30_000], [60_007, 20_000, 1]]


def segmentations(text, pieces):
    """All ways to spell bytes, as lists of piece numbers, one after the other."""
    if not text:
        yield []
    for d in range(1, len(text) + 1):
        for piece in pieces.get(text[:d], ()):
            yield from ([piece, *rest] for rest in segmentations(text[d:], pieces))


def plain_scores(rows, vocabulary):
    """The model as its docstring says, word by word over listed segmentations."""
    pieces = defaultdict(list)
    for b in range(256):
        pieces[bytes([b])].append(b)
    steps = {int(k): int(c) for k, c in zip(vocabulary.keys, vocabulary.child, strict=True)}
    spelt = {0: b""}
    for key in sorted(steps, key=lambda k: steps[k]):  # children are numbered after their parents
        spelt[steps[key]] = spelt[key // 256] + bytes([key % 256])
        if vocabulary.piece[steps[key]] < vocabulary.size:
            pieces[spelt[steps[key]]].append(int(vocabulary.piece[steps[key]]))
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    texts = [(i, zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0, (t or "").encode().translate(low).split(), g) for i, t, g in rows]
    groups = sorted({g for _, h, _, g in texts if not h}, key=str)
    count = {g: Counter(w for _, h, words, g2 in texts if not h and g2 == g for w in words) for g in groups}
    ends = {g: sum(not h and g2 == g for _, h, _, g2 in texts) for g in groups}
    whole = sum(count.values(), Counter())
    total, kinds = sum(whole.values()) + sum(ends.values()), len(whole) + bool(groups)
    weight = {g: np.exp(vocabulary.prior) for g in groups}
    ways = {w: list(segmentations(b" " + w, pieces)) for _, _, words, _ in texts for w in words}
    for g in groups:
        for _ in range(lattice.ROUNDS):
            seen = lattice.STRENGTH * np.exp(vocabulary.prior)
            for w, n in count[g].items():
                shares = [math.prod(weight[g][p] for p in way) for way in ways[w]]
                for way, share in zip(ways[w], shares, strict=True):
                    for p in way:
                        seen[p] += min(n, lattice.DISCOUNT) * share / sum(shares)
            weight[g] = seen / seen.sum()
    out = []
    for i, held, words, _ in texts:
        base = sum(math.log10((whole[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words) + math.log10((sum(ends.values()) + 0.1) / (total + 0.1 * (kinds + 1)))
        found = 0.0
        for g in groups:
            tokens = sum(count[g].values()) + ends[g] + 1
            left = (sum(min(n, lattice.DISCOUNT) for n in count[g].values()) + 0.5) / tokens
            p = ends[g] / sum(ends.values()) * (ends[g] + 0.5) / tokens
            for w in words:
                p *= max(0, count[g][w] - lattice.DISCOUNT) / tokens + left * sum(math.prod(weight[g][q] for q in way) for way in ways[w])
            found += p
        out.append((i, held, len(words) + 1, sum(w in whole for w in words) + bool(groups), total, base, math.log10(found)))
    return out


@pytest.mark.parametrize("frequent", [3, 32_768])
def test_lattice_scores(spark, monkeypatch, frequent):
    monkeypatch.setattr(lattice, "FREQUENT", frequent)
    rnd = np.random.default_rng(6)
    words = ["the", "The", "eau", "eaueau", "thing", "of", "é", "x\u00a0y", "zq", "\u2581a", "ofthe", "!", "ing."]
    rows = [(i, " ".join(rnd.choice(words, int(rnd.integers(0, 9)))), ["en", "fr", None][i % 3]) for i in range(60)]
    rows += [(7, "the the eau", "en"), (None, "of nothing", "en"), (90, None, "fr"), (91, "", None), (92, " \n\t", "fr"), (93, "of", "de")]
    frame = spark.createDataFrame([(*r, 1.0, "clash") for r in rows], "doc_id long, text string, lang string, score double, word string").repartition(3)
    got = lattice.lm_scores(frame, path("piece_bpe_32k.model")).collect()
    expected = plain_scores(rows, lattice.Vocabulary(path("piece_bpe_32k.model")))
    key = lambda r: (str(r[0]), *map(repr, r[1:5]), round(r[5], 6))
    assert any(r[1] for r in expected)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-4)


def test_lattice_scores_without_training_texts_and_of_long_words(spark):
    model = path("piece_bpe_32k.model")
    assert lattice.lm_scores(spark.createDataFrame([], "doc_id long, text string, lang string"), model).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = spark.createDataFrame([(held, "ab", "en"), (held, None, None), (held, "w" * 3000, "en")], "doc_id long, text string, lang string")
    found = lattice.lm_scores(rows, model).collect()
    assert len(found) == 3
    for r in found:
        assert r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0.0 and np.isfinite(r.score) and r.score < 0


def test_lattice_model_beats_the_base_on_texts_it_has_not_seen(spark):
    """Words made of syllables of two languages: new ones are spelt, and a text's language is found."""
    rnd = np.random.default_rng(9)
    parts = {"a": ["eau", "ment", "ou", "la", "que", "tre"], "b": ["ing", "the", "ed", "er", "sh", "ou"]}
    rows = []
    for i in range(400):
        g = "ab"[i % 2]
        rows.append((i, " ".join("".join(rnd.choice(parts[g], int(rnd.integers(1, 5)))) for _ in range(30)), g))
    got = lattice.lm_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string"), path("piece_bpe_32k.model")).where("held_out").collect()
    assert len(got) > 20 and sum(r.score for r in got) > 0.95 * sum(r.base_score for r in got)
