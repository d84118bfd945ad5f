"""Completions and the library's figures on small rows."""

from pyspark.sql import functions as F

from galley.operators import library, recipes, text_search


def test_completions_by_words(spark):
    rows = spark.createDataFrame([("Lemon Tart",), ("lemon tart",), ("Tarte Tatin",), ("Onion Soup",), (None,), ("Hot lemon-tea",)], "title string")
    done = lambda typed, n=8: [tuple(r) for r in library.completions(rows, "title", typed, n).collect()]
    assert done("tart") == [("lemon tart", 2), ("Tarte Tatin", 1)]
    assert done("TA le") == [("lemon tart", 2)]
    assert done("lemon te") == [("Hot lemon-tea", 1)] and done("art") == []
    assert done("", 2) == [("Hot lemon-tea", 1), ("lemon tart", 2)] and done(" - ") == done("")


def test_any_part_of_an_author(spark):
    rows = spark.createDataFrame([("Ann Lee",), ("Bo Leeds",), ("Bo Leeds",), ("",), (None,)], "author string")
    assert [tuple(r) for r in library.containing(rows, "author", " LEE ").collect()] == [("Bo Leeds", 2), ("Ann Lee", 1)]
    assert len(library.containing(rows, "author", "").collect()) == 2


def test_stored_index(spark, tmp_path):
    path = f"file://{tmp_path}/words"
    docs = spark.createDataFrame([(1, "Lemon Tart", "cream and sugar"), (2, "Cream Pie", "lemons"), (3, None, "Crème lemon")], "id int, title string, body string")
    text_search.write_index(docs, "id", ["title", "body"], path)
    found = lambda terms, field=None: {r.id for r in text_search.search_index(spark, path, terms, field).collect()}
    assert found(["lem", "CREAM"]) == {1, 2} and found(["lem"], "title") == {1} and found(["lemons"]) == {2} and found([]) == set() and found(["emon"]) == set()
    text_search.write_index(spark.createDataFrame([(4, "lemonade", None)], "id int, title string, body string"), "id", ["title", "body"], path)
    assert found(["lem"], "title") == {1, 4}
    plan = text_search.search_index(spark, path, ["lem"], "title")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(token,lem)" in plan.split("PushedFilters")[1]


def test_confidence(spark):
    long = "Whisk the eggs. " + "word " * 30
    rows = [
        (True, "Pie", 6, long, "label", "4", 5, 1.0), (False, "", 3, "word", None, "", 1, 0.0), (False, "Pie", 4, "Bake, then eat.\nServe.", "method", "", 2, 0.4), (True, "Pie", 5, "nothing\n  stir, well", "labels-summed", "2", 1, 0.7),
        (None, None, None, None, None, None, None, 0.0),
    ]
    frame = spark.createDataFrame(rows, "h boolean, t string, n int, m string, s string, v string, c int, want double")
    got = frame.select("want", recipes.confidence(*map(F.col, "htnmsvc")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
