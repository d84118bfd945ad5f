"""Recipes cut out of blocks against plain Python, over made books and whole pages."""

import random

from pyspark.sql import functions as F

import __spark_entry__
from galley.operators import recipes
from galley.plans import recipes as plans

SF = "/root/testdata/sf0.001"
SCHEMA = "book long, position int, kind string, level int, bold boolean, text string, is_line boolean"


def part(text):
    key = (text or "").strip(" .:–—-").lower()
    return key in recipes.PARTS or key.startswith("for the") or len(key) < 2


def cut(blocks, fit):
    """Recipes of one book's blocks, which are dicts in order; fit gives the fitness of a block or None."""
    lines = [i for i, b in enumerate(blocks) if b["is_line"]]
    found, out, low = [], [], 0
    for i in lines:
        if found and i - found[-1][-1] <= recipes.GAP + 1:
            found[-1].append(i)
        else:
            found.append([i])
    found = [r for r in found if len(r) >= recipes.LEAST]
    for r in found:
        best = (0.0, r[0], "")
        for i in range(max(low, r[0] - recipes.ABOVE), r[0]):
            points = None if blocks[i]["is_line"] else fit(blocks[i])
            if points is not None and points - 0.2 * (r[0] - 1 - i) >= best[0] and points - 0.2 * (r[0] - 1 - i) > 0:
                best = (points - 0.2 * (r[0] - 1 - i), i, blocks[i]["text"].strip())
        out.append([low, best[1], best[2], r])
        low = r[-1] + 1
    rows = []
    for n, (low, at, title, r) in enumerate(out):
        stop, method = out[n + 1][1] if n + 1 < len(out) else len(blocks), []
        for b in blocks[r[-1] + 1 : min(stop, r[-1] + 1 + recipes.METHOD)]:
            text = (b["text"] or "").strip()
            if not text or b["level"] and text.strip(" .:–—-").lower() in recipes.METHODS:
                continue
            if b["level"] and b["level"] <= 2 and method:
                break
            method.append(text)
        near = [(abs(i - at), i) for i in range(low, stop) if blocks[i]["kind"] == "image"]
        named = [b["text"].strip() for b in blocks[max(0, at - recipes.SECTION + 1) : at] if b["level"] == 1 and not part(b["text"])]
        rows.append((n + 1, at, title, r[0], r[-1], len(r), "\n".join(method), (blocks[min(near)[1]]["text"] or "" if near else ""), named[-1] if named else ""))
    return rows


def held(spark, frame):
    points = recipes.fitness(F.col("kind"), F.col("level"), F.col("bold"), F.trim(F.coalesce("text", F.lit(""))))
    books = {}
    for b in frame.withColumn("fit", points).orderBy("book", "position").collect():
        books.setdefault(b.book, []).append(b.asDict())
    for blocks in books.values():
        assert [b["position"] for b in blocks] == list(range(len(blocks)))
    want = {(k, *row) for k, blocks in books.items() for row in cut(blocks, lambda b: b["fit"])}
    got = [tuple(r) for r in recipes.recipes(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want, (sorted(set(got) - want)[:2], sorted(want - set(got))[:2])
    cooking = [b for blocks in books.values() for b in blocks if b["text"] == "Whisk, then rest"]
    assert all((b["fit"] is not None) == (b["level"] is not None and b["kind"] != "image") for b in cooking)
    fits = {b["text"] for blocks in books.values() for b in blocks if b["fit"] is not None}
    assert not fits & {"Method", "Serves 4", "Makes about 20", "Contents", "x", "", None}
    return got


def test_recipes_of_made_books(spark):
    dice = random.Random(5)
    texts = ["Lemon Tart", "soup", "Method", "For the sauce", "Mix it well and let it stand there.", "Serves 4", "2 eggs", "", None, "Bean and Leek Pie", "Contents", "x", "Whisk, then rest", "Makes about 20"]
    rows = []
    for book in range(40):
        for position in range(dice.choice([0, 5, 60, 300])):
            kind = dice.choice(["text", "text", "heading", "image", "item"])
            level = dice.choice([1, 2, 3]) if kind == "heading" else None
            rows.append((book, position, kind, level, dice.random() < 0.2, dice.choice(texts), kind in ("item", "text") and dice.random() < (0.9 if position % 40 < 12 else 0.1)))
    got = held(spark, spark.createDataFrame(rows, SCHEMA))
    assert len(got) > 50 and any(r[7] for r in got) and any(r[8] for r in got) and any(r[9] for r in got)
    assert recipes.recipes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recipes_of_whole_pages(spark):
    got = held(spark, plans.page_blocks(spark, SF))
    assert got and "page_recipes" in __spark_entry__.queries()


def test_sections_are_near(spark):
    rows = [(b, p, "heading" if p == 0 else "text", 1 if p == 0 else None, False, "Soups" if p == 0 else "x", p > far) for b, far in ((1, 399), (2, 401)) for p in range(far + 4)]
    got = {r.book: (r.section, r.title_at) for r in recipes.recipes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ("", 400), 2: ("", 402)}
    near = spark.createDataFrame([r for r in rows if r[0] == 1 and r[1] > 0] + [(1, 5, "heading", 1, False, "Soups", False)], SCHEMA).where("position <> 5 or kind = 'heading'")
    assert recipes.recipes(near).first().section == "Soups"


def test_servings(spark):
    rows = [("Serves 4 to 6 Prep 10", "", "4 to 6"), ("MAKES: 12 muffins", "", "12 muffins"), ("Serves 6 CINNAMON", "", "6"), ("", "Buns (makes 8)", "8"), ("for 4", None, ""), (None, None, ""), ("Yields 2 loaves", "serves 9", "2 loaves")]
    frame = spark.createDataFrame(rows, "header string, title string, want string")
    assert frame.where(recipes.servings(F.col("header"), F.col("title")) != F.col("want")).count() == 0


def test_titles(spark):
    rows = [("Lemon and Garlic Roast Chicken", True), ("Salt and freshly ground black pepper", False), ("Soup", False), ("", False), ("Ål à la Crème", True)]
    frame = spark.createDataFrame(rows, "text string, want boolean")
    assert frame.where(recipes.is_title_case(F.col("text")) != F.col("want")).count() == 0
