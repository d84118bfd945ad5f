from pyspark.sql import functions as F

from galley.functions import classify, titles

SCHEMA = "title string, section string, names array<string>"


def test_meals_and_cuisines(spark):
    rows = [
        ("Pancakes", "", []), ("Beef stew", "", []), ("Lemon tart", "Mains", []), ("Lemon tart", None, []), ("Thing", "", ["sugar", "flour", "egg"]),
        ("Thing", "", ["sugar", "honey", "onion"]), (None, None, None), ("Crème brûlée", "Spanish plates", ["creme fraiche"]),
        ("Noodles", "", ["miso", "soy sauce"]), ("Noodles", "", ["fish sauce", "lime"]), ("Thai soup", "", []), ("Roast cod", "Dinner and sides", []),
    ]
    t, s, n = F.col("title"), F.col("section"), F.col("names")
    got = spark.createDataFrame(rows, SCHEMA).select(classify.meals(t, s, n).alias("m"), classify.cuisine(t, s, n).alias("c")).collect()
    main = ["lunch", "dinner"]
    assert [r.m for r in got] == [["breakfast"], main, main, ["dessert"], ["dessert"], main, main, main, main, main, ["lunch"], ["dinner", "side"]]
    assert [r.c.cuisine for r in got] == ["american"] + [None] * 6 + ["french", "japanese", None, "thai", None]
    assert got[7].c.score == 7.0


def test_folded(spark):
    rows = [("JALAPEÑO",), ("Smørrebrød straße",), ("été",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "x string").select(classify.folded(F.col("x"))).collect()] == ["jalapeno", "smorrebrod strasse", "ete", ""]


def test_diagnose(spark):
    rows = [("zipfile.BADZIPFILE: x",), ("MemoryError",), ("what",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(classify.diagnose(F.col("x"))).collect()]
    assert [g.cause[:28] for g in got] == ["No zip archive could be open", "Memory ran out on this book.", "Something else kept the book", "Something else kept the book"]
    assert [g.retry for g in got] == [False, True, True, True]


def test_display_title(spark):
    rows = [("MOM'S PIE AND CREAM",), ("bbq chicken of the day",), ("Mixed Case title",), ("BLT",), ("THE (BEST) STEW",), ("123",), ("",), (None,), ("À LA MODE",)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(titles.display_title(F.col("x"))).collect()]
    assert got == ["Mom's Pie and Cream", "BBQ Chicken of the Day", "Mixed Case title", "BLT", "The (Best) Stew", "123", "", None, "À LA Mode"]
