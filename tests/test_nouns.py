from pyspark.sql import functions as F

from galley.functions import nouns

CASES = {
    "Leaves": "leaf", "potatoes": "potato", "berries": "berry", "radishes": "radish", "boxes": "box", "peas": "pea", "hummus": "hummus", "bass": "bass",
    "chillies": "chili", "greens": "greens", "gas": "gas", "onions": "onion", "tahini": "tahini", "": "", None: None,
}


def test_singular(spark):
    rows = spark.createDataFrame([(x,) for x in CASES], "x string").select(nouns.singular(F.col("x"))).collect()
    assert [r[0] for r in rows] == list(CASES.values())
