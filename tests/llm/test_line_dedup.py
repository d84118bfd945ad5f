"""Line dedup against plain Python, over whole output."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from galley.llm import line_dedup


def marked(lines):
    """The marks of a text's lines, as numbers."""
    data = np.frombuffer("".join(lines).encode(), np.uint8)
    at = np.cumsum([0] + [len(x.encode()) for x in lines])
    hashes = line_dedup.hashed(data, at[:-1], at[1:])
    return [int(m) for m in line_dedup.marks(hashes, np.zeros(len(lines), int))]


def split(lines):
    """Chunks of a text's lines as (first, last), by the rule of the docstring."""
    m, starts = marked(lines) if lines else [], [0]
    for i in range(2, len(lines) - 1):
        run = next((j for j in range(i, 0, -1) if lines[j] != lines[j - 1]), 0)
        forced = lines[i - 1] == lines[i] == lines[i + 1] and (i - run) % 2 == 0
        if starts[-1] < i - 1 and (forced or m[i - 1] > m[i] <= m[i + 1]):
            starts.append(i)
    return [(a, b - 1) for a, b in zip(starts, [*starts[1:], len(lines)], strict=True) if b - a > 1]


def brute(rows):
    """Texts after dedup; rows are in the order of their ids."""
    seen, out = {}, []
    for _, text in rows:
        lines = re.findall("[^\n]*\n|[^\n]+", text or "")
        solid = [n for n, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c\n")]
        bare = [lines[n].removesuffix("\n") for n in solid]
        chunks, gone = split(bare), set()
        for k, (a, b) in enumerate(chunks):
            before = bare[chunks[max(0, k - 2)][0] : a][::-1]
            after = bare[b + 1 : chunks[min(len(chunks) - 1, k + 2)][1] + 1]
            body = "".join(lines[solid[a] : solid[b] + 1]).removesuffix("\n")
            if body in seen:
                same = lambda x, y: next((n for n, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
                lo, hi = a - same(before, seen[body][0]), b + same(after, seen[body][1])
                gone |= set(range(solid[lo], solid[hi] + 1))
            else:
                seen[body] = (before, after)
        out.append(None if text is None else "".join(x for n, x in enumerate(lines) if n not in gone))
    return out


def check(spark, texts, **more):
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(frame, **more).collect()}
    assert [got[i] for i, _ in rows] == brute(rows)
    return got


def test_whole_output_equals_brute_force(spark):
    rnd = random.Random(7)
    words = [f"line {i}" for i in range(9)] + ["", " ", "é漢"]
    texts = [None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "a\nb\n", "b\na\nb"] + ["\n".join(rnd.choice(words) for _ in range(rnd.randint(0, 14))) + rnd.choice(["", "\n"]) for _ in range(120)]
    passage = [f"shared {i}" for i in range(30)]
    texts += ["\n".join([f"own {n} {j}" for j in range(rnd.randint(0, 5))] + passage[rnd.randint(0, 8) : rnd.randint(12, 30)] + [f"end {n}"]) for n in range(25)]
    got = check(spark, texts)
    first = Counter(x.strip() for t in texts for x in (t or "").split("\n"))
    assert {x.strip() for t in got.values() for x in (t or "").split("\n")} == set(first)  # no line is lost from the corpus


def test_hashes_that_clash(spark):
    rnd = random.Random(3)
    texts = ["\n".join(f"line {rnd.randint(0, 7)}" for _ in range(rnd.randint(0, 12))) for _ in range(80)]
    check(spark, texts, hash_of=lambda data, lo, hi: line_dedup.hashed(data, lo, hi) % line_dedup.U(3))


@pytest.mark.parametrize("n", range(4))
def test_runs_and_long_passages(spark, n):
    own = lambda k: [f"own {n} {k} {j}" for j in range(6)]
    run, ab, long = [f"run {n}"] * 40, [f"a {n}", f"b {n}"] * 20, [f"line {n} {j}" for j in range(12)]
    texts = ["\n".join(x) for x in (own(0) + run + own(1), own(2) + run[:9] + own(3), own(4) + ab + own(5), own(6) + long + own(7), own(8) + long + own(9), own(10) + long[1:-1] + own(11))]
    got = check(spark, texts)
    assert got[0].count(f"run {n}") <= 6 and got[1].count(f"run {n}") <= 6 and got[2].count(f"a {n}\n") <= 4
    assert got[3] == texts[3] and got[4] == "\n".join(own(8) + own(9)) and got[5] == "\n".join(own(10) + own(11))


def test_blank_lines_and_odd_rows(spark):
    texts = ["x\n\ny\n\nz\n\nv", "new\nold\nnew\n\nx\n\ny\n\nz\n\nv\n", "x\n \ny\n\nz\n\nv"]
    check(spark, texts)
    rows = [(1, "a\nb\nc\n", "k"), (1, "a\nb\nc\n", "l"), (None, "a\nb\nc\n", "m"), (2, "w" * 100_000 + "\na\nb", "n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted((str(r.doc_id), r.key, len(r.text)) for r in line_dedup.line_dedup(frame).collect())
    assert got == [("1", "k", 0), ("1", "l", 0), ("2", "n", 100_004), ("None", "m", 6)]
    assert line_dedup.line_dedup(frame.limit(0)).collect() == []


def test_chunks_move_with_their_text():
    rnd = random.Random(5)
    lines = [f"some line {rnd.randint(0, 10**6)}" for _ in range(400)]
    a, b = split(lines), split(["in front", "of it", "all", *lines])
    moved = {(lo + 3, hi + 3) for lo, hi in a}
    assert len(moved & set(b)) >= len(a) - 2 and 2.5 < sum(hi - lo + 1 for lo, hi in a) / len(a) < 3.5
