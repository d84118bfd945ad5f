"""Nulls, repeated ids, clashing columns, long texts and empty tables, for operators 1, 8 and 10 and the pipeline's stages."""

import hashlib
import struct

import sentencepiece

import corpus_pipeline
from galley.llm import chat, piece_bpe, warc
from public_tokenizers import path

MODEL = "piece_bpe_32k.model"


def test_digests_of_odd_rows(spark):
    texts = [(1, "Hello  world"), (1, "again"), (None, "no id"), (2, None), (3, ""), (4, " \n\t"), (5, "é漢🙂 </s>"), (6, "ab " * 20_000), (7, "x" * 3_000), (8, "      two   blanks " * 30)]
    frame = spark.createDataFrame([(*t, 9, "clash") for t in texts], "doc_id long, text string, n_tokens int, ids string").repartition(3)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_bpe.digests(frame, path(MODEL)).collect())
    model = sentencepiece.SentencePieceProcessor(model_file=path(MODEL))
    right = []
    for i, t in texts:
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        right.append((str(i), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert got == sorted(right)
    assert piece_bpe.digests(frame.limit(0), path(MODEL)).collect() == []
    assert piece_bpe.decode(piece_bpe.encode(frame.limit(0), path(MODEL)), path(MODEL)).collect() == []
    back = {str(r.id): r.text for r in piece_bpe.decode(piece_bpe.encode(frame.where("doc_id > 2"), path(MODEL)), path(MODEL)).collect()}
    assert back["5"] == "é漢🙂 </s>" and back["3"] == ""


def test_pages_that_share_an_id(spark):
    rows = [(1, "u", "<p>same</p>", "a"), (1, "v", "<p>same</p>", "b"), (2, "w", "<p>same</p>", "c"), (1, "x", "<p>other</p>", "d"), (3, "y", "<p>other</p>", "e"), (None, "z", "<p>same</p>", "f"), (4, None, None, "g"), (5, "q", "", "h")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, sha string")
    got = sorted((str(r.page_id), r.html, r.response) for r in warc.typed(frame).collect())
    same, other = "<p>same</p>", "<p>other</p>"
    assert got == sorted([("1", same, None), ("1", same, None), ("2", same, 1), ("1", other, None), ("3", other, 1), ("None", same, None), ("4", "", None), ("5", "", 4)], key=lambda r: (r[0], r[1]))
    assert warc.typed(frame.limit(0)).collect() == []


def test_deep_and_empty_trees(spark):
    """Conversations that part at every turn, each a prefix of the next one and a branch beside it."""
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if t < i else f"end {i}") for i in range(30) for t in range(i + 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    tree = chat.PrefixTree(frame)
    nodes = tree.nodes().collect()
    assert len(nodes) == 29 + 30 and len({r.start for r in nodes}) == len(nodes)
    assert chat.PrefixTree(frame.limit(0)).nodes().collect() == []


def test_stages_keep_clashing_columns_and_empty_tables(spark):
    rows = [(1, "a b c d e f g h", "en", "s", 15), (2, "a b c d e f g h", "en", "s", 15), (None, None, None, None, None), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, component int")
    for stage in (corpus_pipeline.repeated_lines, corpus_pipeline.near_duplicates, corpus_pipeline.repeated_spans):
        assert stage(spark, docs, "").columns == docs.columns
        assert stage(spark, docs.limit(0), "").collect() == []
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3, None}
