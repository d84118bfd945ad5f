"""The pipeline's rows against plain Python."""

import itertools
import random
import zlib

import numpy as np
import pytest
from test_line_dedup import brute as cut_lines
from test_span_dedup import brute as cut_spans

import corpus_pipeline
import public_tokenizers

DOCS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


def near(texts):
    """Which texts stay: the first of each group of 5-word shingle sets linked at 0.8."""
    sets = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        shared = len(sets[i] & sets[j])
        if shared and 5 * shared >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    return [r == i for i, r in enumerate(root)]


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")


def test_rows_equal_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    rnd = random.Random(4)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa la mu nu xi".split()
    sentence = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 9))) + rnd.choice([".", "!", ".\n"])
    shared = ["\n".join(sentence().strip() for _ in range(4)), " ".join(sentence() for _ in range(6))]
    texts = [" ".join(sentence() for _ in range(rnd.randint(4, 14))) for _ in range(50)]
    texts += [texts[3], texts[3] + " more", texts[7].replace("alpha", "omega", 1), f"own start\n{shared[0]}\nown end", f"other start\n{shared[0]}\nother end", texts[9] + " " + shared[1], texts[11] + " " + shared[1]]
    rows = [(i, t, "en", f"host{i % 3}") for i, t in enumerate(texts)] + [(7, "clean text of its own under an id that another row has.", "en", "host1")]
    bad = [(100 + i, " ".join(f"{w}&&&" for w in texts[i].split()), "en", "host9") for i in range(30)]
    labels = [(i, 1, 0) for i in range(0, 50, 2)] + [(100 + i, 0, 0) for i in range(0, 30, 2)]
    write(spark, tmp_path, [(*r, len(r[1])) for r in rows + bad], labels)
    rows.sort(key=lambda r: r[0])
    assert len({r[0] for r in rows}) == len(rows) - 1  # of the two rows with id 7 neither repeats anything
    kept = cut_lines([(i, t) for i, t, _, _ in rows])
    stays = near(kept)
    left = [(r[0], t) for r, t, s in zip(rows, kept, stays, strict=True) if s]
    final = list(zip([i for i, _ in left], cut_spans([t for _, t in left]), strict=True))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for i, t in final:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        expected += [(i, k, s, len(c := ids[s : s + 4096]), zlib.crc32(c.tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    assert len(final) < len(rows) and any(t != k for (_, t), k in zip(final, [t for _, t in left], strict=True))
    for _, held in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        held = list(held)
        assert [r.offset for r in held] == [sum(x.length for x in held[:n]) for n in range(len(held))] and sum(r.length for r in held) <= 4096


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)]])
def test_empty_tables_and_odd_rows(spark, tmp_path, labels):
    docs = [(None, "a text without an id", None, None, 0), (1, None, None, None, 0), (2, "", "en", "x", 0)] if labels else []
    write(spark, tmp_path, docs, labels)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((d[0] is None, d[0] or 0) for d in docs)
    assert len(corpus_pipeline.STAGES) == 5
