"""Operators on small fixtures with nulls, ties, repeats, empty and long texts, clashing columns and empty tables."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from galley.llm import chat, graph, line_dedup, packing, piece_bpe, quality, span_dedup, vectors, warc
from galley.llm.jaccard import JaccardJoin

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "k") for i, t, s in rows], DOCS)


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa la mu nu xi".split()) + ("." if rnd.random() < 0.2 else "") for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    base = prose(1, 120)
    rows = [(1, base, "a"), (2, base, "a"), (3, base + " extra", "b"), (4, None, None), (5, "", "b"), (6, "one two", "b"), (7, "one  TWO", "b"), (None, base, "c"), (8, prose(2, 6000), "c"), (8, prose(2, 6000), "c"), (9, prose(3, 90) + " " + base, "c")]
    return docs(spark, rows), rows


def brute_groups(rows, k, num, den):
    sets = {}
    for i, text, _ in rows:
        w = (text or "").lower().split()
        if i is not None:
            sets.setdefault(i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sorted(sets), 2):
            inter = len(sets[a] & sets[b])
            if inter and den * inter >= num * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    return {i: (len(sets[i]), root[i]) for i in sets}


def test_jaccard(spark, corpus):
    frame, rows = corpus
    extra = [(100 + j, " ".join(w if (n * 7 + j) % 40 else f"x{j}" for n, w in enumerate(prose(5, 80).split())), "z") for j in range(25)]
    got = JaccardJoin(frame.union(docs(spark, extra)), k=4, num=85, den=100).groups().collect()
    expected = brute_groups(rows + extra, 4, 85, 100)
    assert {r.id: (r.n_shingles, r.component) for r in got if r.id is not None} == expected
    assert len(got) == len(rows) + len(extra)
    assert JaccardJoin(frame.limit(0)).groups().collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_line_and_span_dedup(spark, corpus):
    frame, rows = corpus
    block = "first line here\nsecond line here\nthird line here\nfourth line here\nfifth line"
    more = docs(spark, [(20, block, "a"), (21, block, "a"), (22, "shifted\n" + block, "a"), (23, "\n\n\n\n", "a")])
    lines = {(r.doc_id, r.source): r for r in line_dedup.line_dedup(frame.union(more)).collect()}
    assert lines[20, "a"].text == block and len(lines[21, "a"].text) < len(block) and lines[23, "a"].text == "\n\n\n\n"
    assert lines[4, None].text is None and lines[21, "a"].n_chars == len(lines[21, "a"].text)
    spans = {(r.doc_id, r.source): r for r in span_dedup.span_dedup(frame).collect()}
    assert len(spans) == len({(i, s) for i, _, s in rows}) and spans[None, "c"].text == rows[0][1]  # a null id comes first
    rest = spans[1, "a"].text
    assert rest == spans[2, "a"].text == "" and spans[6, "b"].text == "one two"
    assert len(spans[9, "c"].text) < len(rows[-1][1]) and spans[8, "c"].key == "k"
    assert span_dedup.span_dedup(frame.limit(0)).collect() == [] and line_dedup.line_dedup(frame.limit(0)).collect() == []


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    frame, rows = corpus
    tokenizer = Tokenizer.from_file(WORDS)
    got = packing.pack_documents(frame, WORDS, 256).collect()
    expected = sorted(
        (i is None, i or 0, k // 256, k, len(c := ids[k : k + 256]), zlib.crc32(c.tobytes()))
        for i, t, _ in rows for ids in [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")] for k in range(0, len(ids), 256)
    )
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    for _, held in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        end = 0
        for r in held:
            assert r.offset == end
            end += r.length
        assert end <= 256
    lengths = np.array([r.length for r in got])
    assert len({r.sequence_id for r in got}) <= packing.lower_bound(packing.counts(lengths, 256), 256) + 1
    assert packing.pack_documents(frame.limit(0), WORDS).collect() == []


def test_lower_bound_never_exceeds_a_packing():
    rnd = np.random.default_rng(3)
    for _ in range(50):
        lengths = rnd.integers(1, 101, 60)
        assert packing.lower_bound(packing.counts(lengths, 100), 100) <= len(packing.best_fit(lengths, 100)[2])


def test_sentencepiece_equals_the_library():
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_bpe.model(PIECES)
    rnd = random.Random(1)
    texts = [None, "", " ", "  a", "▁", "a▁ b", "</s><s>", "漢字" * 300, "ab" * 2000, " " * 700 + "x", prose(4, 500)]
    texts += ["".join(rnd.choice("aab the▁ \n\té漢😀<0x0A>\x00%12") for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    ids, bounds = own.encode(pa.array(texts, pa.string()))
    for i, (t, d) in enumerate(zip(texts, own.decode(ids, bounds), strict=True)):
        expected = [1, *lib.encode(t or ""), 2]
        assert ids[bounds[i] : bounds[i + 1]].tolist() == expected and d.decode() == lib.decode(expected)


def test_sentencepiece_frames(spark, corpus):
    coded = piece_bpe.encode(corpus[0], PIECES)
    assert sorted(r.text for r in piece_bpe.decode(coded, PIECES).collect()) == sorted(t or "" for _, t, _ in corpus[1])


def test_vectors(spark):
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(12, 16))
    x = np.concatenate([base, base[:6] + 0.15 * rnd.normal(size=(6, 16)), base[:3]]).astype(np.float32)
    rows = [(i, v.tolist(), int(i) % 2 if i < 12 else 0) for i, v in enumerate(x)] + [(50, None, 0), (51, [0.0] * 16, 0), (52, [float("nan")] * 16, 0), (53, [None] * 16, 0), (54, [], 0), (55, x[0].tolist(), None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    links = {i: [j for j, w, m in rows if j != i and l is not None and l == m and i < 50 and j < 50 and np.dot(x[i].astype(float), x[j].astype(float)) / np.linalg.norm(x[i].astype(float)) / np.linalg.norm(x[j].astype(float)) >= 0.9] for i, v, l in rows}
    got = {r.vec_id: r for r in vectors.near_duplicates(frame, 0.9).collect()}
    least = {i: i for i in links}
    for _ in links:
        least = {i: min([least[i], *(least[j] for j in links[i])]) for i in links}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (len(links[i]), least[i], least[i] == i) for i in links}
    z = {i: np.floor(256 * x[i].astype(float)).astype(int) for i in range(len(x))} | {55: np.floor(256 * x[0].astype(float)).astype(int), 51: np.zeros(16, int)}
    top = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vectors.top_k(frame, F.col("vec_id") % 5 == 0).collect())
    expected = [(q, n + 1, j, s) for q in sorted(z) if q % 5 == 0 for n, (s, j) in enumerate(sorted(((int(z[q] @ z[j]), j) for j in z if j != q), key=lambda p: (-p[0], p[1]))[:5])]
    assert top == expected
    assert vectors.near_duplicates(frame.limit(0)).collect() == [] and vectors.top_k(frame.limit(0), F.lit(True)).collect() == []


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (2, 0, "user", "hi"), (2, 1, "assistant", "</s>\\<|text|>"), (2, 2, None, None), (3, 0, "user", "yo"), (None, 0, "user", "hi"), (2, 2, None, None)]
    tree = chat.PrefixTree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    nodes = {r.node: r for r in tree.nodes().collect()}
    assert sum(r.length for r in nodes.values()) == max(r.start + r.length for r in nodes.values())
    for r in nodes.values():
        seen, up = set(), nodes.get(r.parent)
        while up:
            seen |= set(range(up.start, up.start + up.length))
            up = nodes.get(up.parent)
        assert {p for s in r.attend for p in range(s.lo, s.hi)} == seen and len(seen) == r.position
    got = {r.conv_id: r for r in chat.digests(tree).collect()}
    said = "user\nhi\nassistant\n</s>\\<|text|>\n\n\n\n\n"
    assert got[2].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[2].n_turns == 4
    assert got[2].loss_sha256 == hashlib.sha256(b"</s>\\<|text|>").hexdigest() and set(got) == {1, 2, 3, None}


@pytest.mark.parametrize("text", ["", "\\", "\\<|", "<|turn|>", "<<SYS>>[INST]</s>", "\\\\[/INST]\n"])
def test_escape_is_reversible(text):
    turn = chat.format_turn(text, text)[0]
    assert chat.parse_turn(turn) == (text, text) and turn.count("<|") == 3 and "</s>" not in turn


def test_warc(spark):
    page = "<p>x</p>" * 50
    rows = [(3, "u", page), (1, "http://a/é b", page), (2, None, None), (5, "u", ""), (4, "u", "other\r\n\r\nWARC/1.1"), (None, "u", "other")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    from galley.llm import common

    files = warc.write_archives(warc.typed(frame), common.shared_dir(spark) + "/warc-test", warc.train_dictionary(frame))
    got = {r.page_id: r for r in warc.read_archives(files).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 3: ("revisit", 1), 2: ("response", None), 5: ("revisit", 2), 4: ("response", None), None: ("response", None)}
    assert bytes(got[4].payload).decode() == rows[4][2] and got[3].payload_bytes == len(page)
    raw = warc.record(1, "u", b"abc", None)
    for bad in (raw[:-5], raw.replace(b"abc", b"abd"), raw.replace(b"WARC/1.1", b"XARC/1.1", 1)):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)


def test_quality(spark):
    good = [(i, prose(i, 60), f"host{i % 3}") for i in range(60)]
    bad = [(100 + i, " ".join(f"{w}&&&" for w in prose(i, 60).split()), "host9") for i in range(40)] + [(200, None, None), (201, "", "host1")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(100 + i, 0, 0) for i in range(0, 40, 2)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify_documents(docs(spark, good + bad), labels).collect()}
    assert all(got[i].keep for i in range(60)) and not any(got[100 + i].keep for i in range(40)) and len(got) == 102
    assert got[101].path_posterior < 0.5 < got[1].path_posterior
    assert quality.classify_documents(docs(spark, good).limit(0), labels).collect() == []
    assert all(r.keep is not None for r in quality.classify_documents(docs(spark, good), labels.limit(0)).collect())
