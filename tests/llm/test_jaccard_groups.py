"""The Jaccard join's groups: sets that meet whole groups of near copies lose no link."""

import random

import pytest

from pyspark.sql import functions as F

from galley.llm.graph import components
from galley.llm.jaccard import JaccardJoin, fewest, overlap


@pytest.mark.parametrize(("num", "den"), [(85, 100), (4, 5), (1, 2)])
def test_no_size_between_the_ends_needs_less_than_the_bound(spark, num, den):
    least = lambda x, y: -(-(x + y) * num // (num + den)) - -(-num * max(x, y) // den) + 1
    rows = []
    for n in range(1, 90):
        sizes = [y for y in range(1, 2 * n + 2) if den * min(n, y) >= num * max(n, y)]
        for lo in sizes:
            low = 10**9
            for hi in range(lo, sizes[-1] + 1):
                low = min(low, least(n, hi))
                rows.append((n, lo, hi, max(1, low)))
    frame = spark.createDataFrame(rows, "n long, lo long, hi long, right long")
    bound = F.expr(fewest(overlap(num, den)[1]))
    assert frame.where(bound > F.col("right")).isEmpty()
    assert frame.where(bound < F.col("right") - 1).isEmpty()


@pytest.mark.parametrize(("num", "den", "common", "more"), [(85, 100, 29, (0, 1, 2, 3)), (4, 5, 20, (1, 2, 3))])
def test_a_set_whose_only_partner_is_in_a_group_of_many_sizes(spark, num, den, common, more):
    """x needs one n-gram fewer for y's size than for the least and the greatest size in y's group."""
    rnd = random.Random(2)
    s, u, extra = [f"s{i}" for i in range(common)], [f"u{i}" for i in range(4)], [f"e{i}" for i in range(12)]
    texts = {5000: s + u, 5001: [*s, "own"]}
    drops = [(a, b) for a in range(5, common) for b in range(a + 1, common)]
    rnd.shuffle(drops)
    for n in range(276):
        a, b = drops[n % len(drops)]
        more_words = rnd.sample(extra, more[n % len(more)])
        texts[n] = u + [w for i, w in enumerate(s) if i not in (a, b)] + more_words
    for n in range(160):  # u is rarer than s, and s begins with its rarest
        texts[10_000 + n] = (s if n < 100 else s[5:]) + [f"own{n}x{i}" for i in range(60)]
    rows = [(i, " ".join(w)) for i, w in texts.items()]
    join = JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k=1, num=num, den=den)
    sets = {i: set(w) for i, w in texts.items()}
    links = lambda i: {j for j in sets if j != i and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])}
    assert links(5001) == {5000} and links(5000) - {5001}
    groups = spark.createDataFrame([(i, 0) for i in (*range(276), 5000)], "node long, component long")
    pairs = {(r.a, r.b) for r in join._candidates(groups).collect()}
    assert (5000, 5001) in pairs


@pytest.mark.parametrize("seed", [1])
def test_groups_are_the_components_of_all_links(spark, seed):
    """Clusters of hundreds of near copies, with strangers that share words with them or link to one member."""
    rnd = random.Random(seed)
    rows, number = [], 0
    for c in range(4):
        core = [f"c{c}w{i}" for i in range(rnd.randint(18, 40))]
        for _ in range(rnd.randint(60, 220)):
            text = [w for w in core if rnd.random() > 0.06] + [f"f{rnd.randint(0, 40)}" for _ in range(rnd.randint(0, 3))]
            rows.append((number, " ".join(text)))
            number += 1
        for _ in range(25):
            text = [w for w in core if rnd.random() > 0.15] + [f"f{rnd.randint(0, 40)}" for _ in range(rnd.randint(0, 6))]
            rows.append((number, " ".join(text)))
            number += 1
    rnd.shuffle(rows)
    join = JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k=1, num=4, den=5)
    found = {r.id: r.component for r in join.groups().collect()}
    named = {r.node: r.component for r in components(join.links()).collect()}
    node = {r.id: r.node for r in join.members().collect()}
    assert found == {i: named.get(node[i], node[i] if node[i] is not None else i) for i, _ in rows}
    sets = {i: frozenset(t.split()) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert found == {i: top(i) for i in ids}


def test_near_copies_that_do_not_link_are_no_pairs(spark, monkeypatch):
    """Copies of a text with 5 to 16 words exchanged: most pairs share enough of their prefixes, few link. What differs behind
    the prefixes leaves few pairs, every link among them, and pairs are not joined with groups once more."""
    rnd = random.Random(3)
    core, rows = [f"w{i}" for i in range(146)], []
    for n in range(300):
        gone = set(rnd.sample(range(146), rnd.randint(5, 16)))
        rows.append((n, " ".join(f"own{n}x{i}" if i in gone else w for i, w in enumerate(core))))
    join = JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k=1, num=4, den=5)
    sets = {i: set(t.split()) for i, t in rows}
    links = {(i, j) for i in sets for j in range(i + 1, 300) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    alone = spark.createDataFrame([(i, i) for i in sets], "node long, component long")
    pairs = {(r.a, r.b) for r in join._candidates(alone).collect()}
    assert links <= pairs and len(pairs) < 2 * len(links)
    asked, apart = [], JaccardJoin._apart
    monkeypatch.setattr(JaccardJoin, "_apart", staticmethod(lambda p, g: asked.append(p.count()) or apart(p, g)))
    root = {i: i for i in sets}
    for i, j in sorted(links):
        a, b = sorted((root[i], root[j]))
        root = {k: a if r == b else r for k, r in root.items()}
    assert {r.id: r.component for r in join.groups().collect()} == root
    assert 1 < len(set(root.values())) < 200 and max(asked) < 10 * len(rows)
