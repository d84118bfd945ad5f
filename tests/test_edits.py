"""Corrections: limits, differences, new readings, times, folded lines and counts."""

import random

from pyspark.sql import functions as F

from galley import vocabulary
from galley.operators import edits

VALUES = "title string, servings string, total_minutes {}, ingredients array<string>, instructions string"
VERSION = "id int, " + VALUES.format("int") + ", active_minutes int, time_source string"
CHANGE = "id int, at int, fields array<string>, " + VALUES.format("string")
EDIT = "id int, fields array<string>, " + VALUES.format("int")


def change(i, at, **v):
    return (i, at, list(v), *(v.get(f) for f in edits.EDITABLE))


def test_limits(spark):
    rows = [
        change(1, 0, title="  "), change(2, 0, title="x" * 201), change(3, 0, servings="s" * 61), change(4, 0, total_minutes="soon"), change(5, 0, total_minutes="0"), change(6, 0, total_minutes="10081"), change(7, 0, ingredients=["", " "]),
        change(8, 0, ingredients=["a"] * 201), change(9, 0, ingredients=["b" * 501]), change(10, 0, instructions="m" * 50_001), change(11, 0, title=" Pie ", total_minutes=" 45 ", ingredients=[" a ", ""]), change(12, 0, total_minutes=None), change(13, 0, colour="red"),
    ]
    got = {r.id: r for r in edits.checked(spark.createDataFrame(rows, CHANGE)).collect()}
    assert {i for i, r in got.items() if r.error is None} == {11, 12}
    assert (got[11].title, got[11].total_minutes, got[11].ingredients, got[11].servings) == ("Pie", 45, ["a"], None)
    assert len({r.error for r in got.values()}) == 11


def test_saving_and_new_readings(spark):
    book = [
        (1, "Pie", "4", 60, ["2 eggs", "salt"], "Mix. Bake. Cool. Cut. Eat.", 20, "label"), (2, "Soup", "2", 10, ["1 leek"], "Boil for 10 minutes.", None, "method"), (3, "Tea", "1", 5, ["tea"], "Steep.", 5, "label"),
    ]
    versions, none = spark.createDataFrame(book, VERSION), spark.createDataFrame([], EDIT)
    made = edits.checked(spark.createDataFrame([
        change(1, 1, title="Tart"), change(1, 2, title="Flan", servings=" 4 ", ingredients=["2 eggs ", "", "salt"], instructions="Mix.\n\nBake.\n\nCool.\n\nCut.\n\nEat."),
        change(2, 1, instructions="Boil for 25 minutes."), change(3, 1, total_minutes="3"), change(9, 1, title="Gone"), change(3, 2, title=""),
    ], CHANGE))
    kept = edits.save(none, versions, made, ["id"])
    found = {r.id: r for r in kept.collect()}
    # The method is one step in the book, as its sentences are short, and five in the change.
    assert {i: r.fields for i, r in found.items()} == {1: ["title", "instructions"], 2: ["instructions"], 3: ["total_minutes"]}
    now = {r.id: r for r in edits.applied(versions, kept, ["id"]).collect()}
    assert now[1].title == "Flan" and now[1].total_minutes == 60 and now[1].edited
    assert (now[2].total_minutes, now[2].time_source) == (25, "method")
    assert (now[3].total_minutes, now[3].active_minutes, now[3].time_source) == (3, None, "edited")
    # The book is read again: what nobody corrected changes, corrections stay, one recipe is gone and its correction waits.
    fresh = spark.createDataFrame([(1, "Pye", "6", 70, ["3 eggs"], "Whip.", 30, "label"), (2, "Soup", "2", None, ["1 leek"], "?", None, "unknown")], VERSION)
    again = {r.id: r for r in edits.applied(fresh, kept, ["id"]).collect()}
    assert again[1].title == "Flan" and again[1].servings == "6" and again[1].ingredients == ["3 eggs"] and set(again) == {1, 2}
    back = edits.save(kept, versions, edits.checked(spark.createDataFrame([change(3, 3, total_minutes="5")], CHANGE)), ["id"])
    assert {r.id for r in back.collect()} == {1, 2}
    assert {r.id for r in edits.reverted(back, spark.createDataFrame([(1,)], "id int"), ["id"]).collect()} == {2}


def test_folded_lines(spark):
    rows = spark.createDataFrame([(1, ["salt and pepper", "For the sauce:", "1 tsp salt", "2 eggs", "(note)"])], "id int, ingredients array<string>")
    got = {r.line for r in edits.folded(rows, vocabulary.frame(spark), ["id"]).collect()}
    assert got == {"1 tsp salt", "(note)"}


def test_counts_after_random_corrections(spark):
    dice = random.Random(4)
    links = {r: {dice.randrange(12) for _ in range(4)} for r in range(30)}
    frame = lambda some: spark.createDataFrame([(r, i) for r, held in some.items() for i in held], "recipe int, ingredient int")
    stored = frame(links).groupBy("ingredient").agg(F.count("*").alias("n"))
    for _ in range(3):
        touched = dice.sample(range(30), 6)
        new = {r: {dice.randrange(15) for _ in range(dice.randrange(1, 5))} for r in touched}
        stored = spark.createDataFrame(edits.counts(stored, frame({r: links[r] for r in touched}), frame(new)).collect(), "ingredient int, n long")
        links |= new
        full = {}
        for held in links.values():
            for i in held:
                full[i] = full.get(i, 0) + 1
        assert {r.ingredient: r.n for r in stored.collect() if r.n} == full
