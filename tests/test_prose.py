from pyspark.sql import functions as F

from galley.functions import prose

CASES = {
    "Heat to 300°F.": "Heat to 150°C.", "set at 475 degrees F, then 400 f": "set at 245°C, then 205°C", "an 8-inch pan": "an 20 cm pan", "strips 3/4 inch wide": "strips 2 cm wide",
    "3 lbs of veal": "1.35 kg of veal", "grill at 450°F (230°C), then 350 (180 degrees C)": "grill at 230°C, then 180°C", "Rest 15 minutes.": "Rest 15 minutes.", "Warm to 90°C.": "Warm to 90°C.",
    "2 1/2 cups rice, 3 cups stock": "600 ml rice, 720 ml stock", "¾ of a leek": "¾ of a leek", "212 degrees Fahrenheit [100 °C] exactly": "100°C exactly", "4 ounces": "115 g", "": "", None: None,
}


def test_convert_text(spark):
    rows = spark.createDataFrame([(x,) for x in CASES], "x string").select(prose.convert_text(F.col("x"))).collect()
    assert [r[0] for r in rows] == list(CASES.values())
