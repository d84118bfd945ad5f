from pyspark.sql import functions as F

from galley.functions import measures
from galley.operators import keyed, match, shopping


def test_amounts(spark):
    lines = {
        "rice": ["120 g rice", "90 g rice"], "veal": ["1.5 kg veal", "750 g veal"], "broth": ["450 ml broth", "0.25 l broth"], "sesame oil": ["1 tbsp sesame oil", "2 tbsp sesame oil"],
        "cumin": ["1 tsp cumin", "½ tsp cumin", "½ tsp cumin"], "leek": ["3 leeks", "2 leeks"], "cream": ["½ cup cream"], "chili": ["2 slices chili", "1 tbsp chopped chili", "1 slice chili"], "sumac": ["sumac"],
    }
    df = spark.createDataFrame([(k, x) for k, xs in lines.items() for x in xs], "key string, line string")
    q = measures.parse_quantity(F.col("line"))
    got = shopping.amounts(df.select("key", q["quantity"].alias("quantity"), q["unit"].alias("unit")))
    assert {r["key"]: r["amount"] for r in got.collect()} == {
        "rice": "210 g", "veal": "2.25 kg", "broth": "700 ml", "sesame oil": "3 tbsp", "cumin": "2 tsp", "leek": "5", "cream": "120 ml", "chili": "1 tbsp + 3 slices", "sumac": "",
    }


def test_overlay_keeps_what_is_not_named(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "c", 7)], "id int, title string, minutes int")
    edits = spark.createDataFrame([(1, '{"minutes": null}'), (2, '{"title": "B"}')], "id int, fields string")
    got = keyed.overlay(rows, edits, ["id"], "title string, minutes int")
    assert sorted(map(tuple, got.collect())) == [(1, "a", None), (2, "B", 6), (3, "c", 7)]


def test_editions_without_a_key_stay(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None)], "id int, e string")
    assert sorted(r["id"] for r in match.one_per_edition(rows, "e", ["id"]).collect()) == [1, 3, 4]
