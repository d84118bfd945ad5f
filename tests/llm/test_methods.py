"""The deciding paths of the methods with small tiles, shards, groups and dictionaries, against brute force."""

import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from galley.llm import chat, common, jaccard, packing, piece_bpe, quality, vectors, warc
from public_tokenizers import path

VECTORS = "vec_id long, embedding array<float>, label int, size string"


def thue_morse(n=10):
    a, b = "x", "y"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.fixture(scope="module")
def cloud(spark):
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(40, 10))
    x = np.concatenate([base, base[:30] + 0.2 * rnd.normal(size=(30, 10)), base[:8], [[3, 4] + [0] * 8, [1] + [0] * 9]]).astype(np.float32)
    rows = [(i // 2 if i in (10, 11) else i, v.tolist(), i % 2 if i < 76 else 5, "clash") for i, v in enumerate(x)] + [(200, [1.0, 2.0], 1, "short"), (201, None, 1, "null")]
    return spark.createDataFrame(rows, VECTORS).coalesce(3), rows


@pytest.mark.parametrize(("tile", "block", "least"), [(3, 2, 0.93), (8, 1, 0.9), (2, 4, 0.6), (1024, 8, 0.93)])
def test_near_duplicates_over_many_tiles(cloud, tile, block, least):
    frame, rows = cloud
    good = [n for n, r in enumerate(rows) if r[1] is not None]
    links = {n: [] for n in range(len(rows))}
    for a in good:
        for b in good:
            u, v = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if a != b and rows[a][2] == rows[b][2] and len(u) == len(v) and (u / np.linalg.norm(u)) @ (v / np.linalg.norm(v)) >= least:
                links[a].append(b)
    root = {n: r[0] for n, r in enumerate(rows)}
    for _ in rows:
        root = {n: min([root[n], *(root[m] for m in links[n])]) for n in root}
    got = vectors.near_duplicates(frame, least, tile=tile, block=block).collect()
    if least == 0.6:  # (3, 4, 0, ...) and (1, 0, ...) are at 0.6 exactly
        assert {r.n_links for r in got if r.vec_id in (78, 79)} == {1}
    assert sorted((r.vec_id, r.n_links) for r in got) == sorted((r[0], len(links[n])) for n, r in enumerate(rows))
    assert sorted((r.vec_id, r.component_id) for r in got) == sorted((r[0], root[n]) for n, r in enumerate(rows))


@pytest.mark.parametrize(("shard", "block", "k", "scale"), [(4, 3, 5, 256), (16, 2, 3, 256), (4096, 512, 100, 256), (8, 8, 4, 2**28)])
def test_search_over_many_shards(cloud, shard, block, k, scale):
    frame, rows = cloud
    z = [(r[0], [int(np.floor(np.float64(np.float32(v)) * scale)) for v in r[1]]) for r in rows if r[1] is not None]
    expected = []
    for q in sorted({i for i, _ in z if i % 7 == 0}):
        own = min(v for i, v in z if i == q)
        scores = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in z if i != q and len(v) == len(own))
        expected += [(q, n + 1, -s, i) for n, (s, i) in enumerate(scores[:k])]
    got = vectors.top_k(frame, F.col("vec_id") % 7 == 0, k, scale, shard, block).collect()
    assert sorted((r.query_id, r["rank"], r.score) for r in got) == sorted(e[:3] for e in expected)
    assert sorted((r.query_id, r.vec_id, r.score) for r in got) == sorted((e[0], e[3], e[2]) for e in expected)


def test_search_bounds_skip_and_probe():
    rnd = np.random.default_rng(1)
    x = np.floor(rnd.normal(size=(300, 20)) * 50)
    x[:, 7] = np.where(rnd.random(300) < 0.9, 0, x[:, 7])  # a sparse list
    shard = vectors.Shard(np.arange(300), x, np.float64)
    q = x[5] * np.geomspace(1, 0.01, 20)
    full = sorted((-(x[i] @ q), i) for i in range(300) if i != 5)[:4]
    for bar in (-np.inf, -full[3][0], 0.0):
        ids, score, up = vectors.max_score(shard, 5, np.floor(q), bar if bar <= 0 else 0.0, 4)
        best = sorted((-(x[i] @ np.floor(q)), i) for i in range(300) if i != 5)[:4]
        assert [(-s, i) for s, i in zip(score.tolist(), ids.tolist(), strict=True)] == best and up == -best[3][0]
    assert len(vectors.max_score(shard, 5, np.floor(q), 1e9, 4)[0]) == 0


def test_jaccard_links_and_words_that_defeat_polynomial_hashes(spark):
    a, b = thue_morse()
    words = [f"w{i}" for i in range(103)]
    texts = [a, b, " ".join(words), " ".join(words[:-15]), " ".join(words[:-16]), " ".join(words), None, "  "]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    join = jaccard.JaccardJoin(frame, k=4, num=85, den=100)  # 100 shingles; 85 and 84 of them
    got = {r.id: (r.n_shingles, r.component) for r in join.groups().collect()}
    assert got == {0: (1, 0), 1: (1, 1), 2: (100, 2), 3: (85, 2), 4: (84, 2), 5: (100, 2), 6: (0, 6), 7: (0, 7)}
    assert {(r.a, r.b) for r in join.links().collect()} == {(2, 3), (3, 4)}
    assert {r.id: r.n_links for r in join.linked().collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 1, 5: 2, 6: 0, 7: 0}


def test_all_links_of_many_near_copies(spark):
    rnd = np.random.default_rng(8)
    base = rnd.integers(0, 5000, 60)
    sets, rows = [], []
    for i in range(60):
        w = base.copy()
        w[rnd.integers(0, 60, rnd.integers(0, 4))] = 9000 + i
        rows.append((i, " ".join(map(str, w))))
        sets.append({tuple(w[j : j + 4]) for j in range(57)})
    expected = {(i, j) for i in range(60) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    join = jaccard.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"), k=4, num=4, den=5)
    node = {r.id: r.node for r in join.members().collect()}
    found = {(r.a, r.b) for r in join.links().collect()}
    assert found == {tuple(sorted((node[i], node[j]))) for i, j in expected if node[i] != node[j]}


@pytest.mark.parametrize("group", [4, 16, 10_000])
def test_packing_exchanges_between_groups(spark, group):
    rnd = np.random.default_rng(2)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rnd.integers(1, 61, 300))]
    placed = packing.pack(spark.createDataFrame(rows, packing.PIECES).repartition(3), 100, group).cache()
    got = placed.collect()
    assert sorted((r.doc_id, r.length) for r in got) == [(r[0], r[3]) for r in rows]
    bins = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    found, bound = packing.certified(placed, 100)
    assert max(bins.values()) <= 100 and len(bins) == found and bound <= found <= bound * (1.25 if group == 4 else 1.06) + 1


def test_merges_whose_order_matters():
    import sentencepiece

    file = path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=file), piece_bpe.model(file)
    assert own.lone.any() and not own.lone.all()
    rnd = np.random.default_rng(3)
    texts = ["".join(rnd.choice(list(s), n)) for s in ("ab", "  x", "-=_*", "\n\t ", "the", "abcdefghijklmnopqrstuvwxyz") for n in (40, 900)]
    texts += [" " * 3000, "a" * 5000, "ththe" * 900, "漢" * 999, "<0x0A>" * 99, "é" * 401]
    ids, bounds = own.encode(piece_bpe.pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [1, *lib.encode(t), 2]


def test_archives_with_a_dictionary(spark, tmp_path):
    page = lambda i: f"<html><head><title>page {i}</title></head><body>" + f"<p class='entry'>number {i} of many</p>" * (1 + i % 7) + "</body></html>"
    rows = [(i, f"http://h/{i}", page(i % 150), "clash") for i in range(300)] + [(900, None, "x" * 3_000_000, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, response string")
    book = warc.train_dictionary(frame)
    assert book[:4] == struct.pack("<I", warc.DICT)
    files = warc.write_archives(warc.typed(frame), common.shared_dir(spark) + "/warc-dictionary", book)
    got = {r.page_id: r for r in warc.read_archives(files).collect()}
    assert {i: (r.record_type, r.refers_to, r.payload and bytes(r.payload).decode()) for i, r in got.items()} == {
        i: ("revisit", i - 150, None) if 150 <= i < 300 else ("response", None, t) for i, _, t, _ in rows
    }
    data = open(files.first().file.removeprefix("file:").replace("//", "/"), "rb").read()
    assert struct.unpack_from("<I", data)[0] == warc.DICT_FRAME
    size = struct.unpack_from("<I", data, 4)[0]
    frames = list(warc.frames(data))
    raw = struct.pack("<II", warc.DICT_FRAME, len(book)) + book + data[8 + size :]
    assert list(warc.frames(raw)) == frames  # an uncompressed dictionary
    broken = [data[:100], data[:-3], data[: 8 + size] + data, data[: 8 + size] + b"\0" * 20 + data[8 + size :], struct.pack("<II", warc.DICT_FRAME, 4) + b"none"]
    for bad in broken:
        with pytest.raises((warc.WarcError, zstandard.ZstdError)):
            list(warc.frames(bad))
    none = frame.limit(0)
    assert warc.train_dictionary(none) == b"" and warc.read_archives(warc.write_archives(warc.typed(none), common.shared_dir(spark) + "/warc-none")).collect() == []


def test_chat_of_long_and_empty_tables(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", "word " * (t % 9), "clash") for t in range(3000)] + [(2, 0, "assistant", "x" * 500_000, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string")
    got = {r.conv_id: r for r in chat.digests(chat.PrefixTree(frame)).collect()}
    sizes = [len(chat.format_turn(r[2], r[3])[0]) for r in rows[:3000]]
    assert got[1].n_turns == 3000 and got[1].positions == got[1].attended == sum(sum(sizes[:i]) for i in range(3000)) and got[2].loss_chars == 500_000
    assert chat.digests(chat.PrefixTree(frame.limit(0))).collect() == []


def test_posteriors_equal_plain_python(spark):
    rows = [(i, " ".join(["good words here."] * (3 + i % 5)) if i % 4 else "&&& %%%", f"h{i % 6}" if i % 7 else None, f"p{i % 3}") for i in range(90)]
    frame = spark.createDataFrame([(*r, 9.0, "x") for r in rows], "doc_id long, text string, host string, path string, quality double, keep string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(60)], "doc_id long, quality int")
    got = quality.classify(frame, labels, F.col("host"), F.col("path"), carry=["doc_id", "host", "path", "quality"]).collect()
    s = {r.doc_id: r.doc_score for r in got}
    host, place = {i: r[2] or "" for i, r in enumerate(rows)}, {i: (r[2] or "", r[3]) for i, r in enumerate(rows)}
    groups = lambda key: {k: [s[i] for i in s if key[i] == k] for k in set(key.values())}
    hosts, places, mean = groups(host), groups(place), float(np.mean(list(s.values())))

    def strength(parts, centre):
        n = sum(map(len, parts.values()))
        between = sum(len(v) * (np.mean(v) - centre(k)) ** 2 for k, v in parts.items())
        inside = sum(sum((x - np.mean(v)) ** 2 for x in v) for v in parts.values())
        spread = max(between - inside / max(n - len(parts), 1) * len(parts), 0) / n
        return min(max(mean * (1 - mean) / max(spread, 1e-9) - 1, 4), 1e4)

    wide, fine = strength(hosts, lambda _: mean), strength(places, lambda k: np.mean(hosts[k[0]]))
    logit = lambda p: np.log(p / (1 - p))
    for r in got:
        h = (sum(hosts[host[r.doc_id]]) - r.doc_score + wide * mean) / (len(hosts[host[r.doc_id]]) - 1 + wide)
        p = (sum(places[place[r.doc_id]]) - r.doc_score + fine * h) / (len(places[place[r.doc_id]]) - 1 + fine)
        clip = lambda x: min(max(x, 1e-6), 1 - 1e-6)
        q = 1 / (1 + np.exp(-(logit(clip(r.doc_score)) + logit(clip(p)) - logit(clip(mean)))))
        assert np.allclose([r.host_posterior, r.path_posterior, r.quality], [h, p, q], rtol=1e-9) and r.keep == (r.quality >= 0.5)
    assert all(r.keep == (r.doc_id % 4 > 0) for r in got)
