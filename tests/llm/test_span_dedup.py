"""Span dedup against plain Python, over whole output."""

import random
import re

from galley.llm import span_dedup


def sentences(text):
    """(first character, words) of each; sentences here are short enough not to be cut further."""
    words, out, fresh = list(re.finditer(r"[^ \t-\r]+", text)), [], True
    for i, w in enumerate(words):
        if fresh:
            out.append((w.start(), []))
        out[-1][1].append(re.sub("[A-Z]+", lambda m: m[0].lower(), w[0]))
        gap = text[w.end() : words[i + 1].start()] if i + 1 < len(words) else "\n"
        fresh = bool(re.search(r"[.!?]$|[.!?][\"')\]]$", w[0])) or "\n" in gap
    assert all(len(x) <= span_dedup.LONG for _, x in out)
    return out


def brute(texts):
    """From each sentence, and up to each sentence, the shortest run of 3 or more with 12 or more words is a span."""
    seen, out = set(), []
    for text in texts:
        parts, gone, spans = sentences(text or ""), set(), set()
        fits = lambda i, j: i >= 0 and j <= len(parts) and j - i >= 3 and sum(len(w) for _, w in parts[i:j]) >= 12
        for i in range(len(parts)):
            spans |= {next(((i, j) for j in range(i, len(parts) + 1) if fits(i, j)), None), next(((k, i + 1) for k in range(i, -1, -1) if fits(k, i + 1)), None)}
        for i, j in sorted(spans - {None}):
            run = tuple(w for _, words in parts[i:j] for w in words)
            gone |= set(range(i, j)) if run in seen else set()
            seen.add(run)
        edges = [at for at, _ in parts] + [len(text or "")]
        kept = "".join((text or "")[a:b] for n, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if n not in gone)
        out.append(None if text is None else text[: edges[0]] + kept)
    return out


def test_whole_output_equals_brute_force(spark):
    rnd = random.Random(11)
    pool = [" ".join(rnd.choice(["One", "two", "é漢", "it's", "(four)", "Fünf"]) for _ in range(rnd.randint(1, 7))) + rnd.choice([".", "!", '?"', ".)", "\n", ".\n\n"]) for _ in range(14)]
    passages = [[rnd.choice(pool) for _ in range(rnd.randint(2, 9))] for _ in range(12)]
    texts = [None, "", " ", "\n", "one", (passages[0][0] + " ") * 30]
    texts += [rnd.choice(["", " ", "\n"]) + rnd.choice([" ", "  "]).join(s for _ in range(rnd.randint(1, 5)) for s in rnd.choice([*passages, [rnd.choice(pool)]])) for _ in range(100)]
    got = {r.doc_id: r.text for r in span_dedup.span_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    expected = brute(texts)
    assert [got[i] for i in range(len(texts))] == expected
    assert sum(a != b for a, b in zip(texts, expected, strict=True)) > 50


def test_words_that_defeat_polynomial_hashes(spark):
    a, b = "x", "y"
    for _ in range(10):
        a, b = a + b, b + a
    assert len(a) == 1024
    texts = [f"{w}. one two three four. five six seven eight. nine ten eleven twelve now." for w in (a, b)]
    got = {r.doc_id: r.text for r in span_dedup.span_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == texts[0] and got[1].startswith(f"{b}.")
