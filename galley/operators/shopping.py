"""Amounts of a shopping list added up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import measures

# Units that are counted, not measured.
COUNTED = ["clove", "can", "slice", "sprig", "bunch", "head", "stalk", "sheet", "fillet", "rasher", "package", "jar", "piece", "handful", "pinch", "dash"]
_G = {"g": 1.0, "kg": 1000.0} | measures.GRAMS
_ML = {"ml": 1.0, "l": 1000.0} | {u: v for u, v in measures.ML.items() if u not in ("tsp", "tbsp")}
_TSP = {"tsp": 1.0, "tbsp": 3.0}


def totals(lines: DataFrame) -> DataFrame:
    """(key, grams, ml, tsp, n_lines) of lines (key, quantity, unit): sums of what can be added, null where nothing was.
    Partial sums are made before the shuffle."""
    q = F.col("quantity")
    sums = [F.sum(q * measures.lookup(F.col("unit"), t)).alias(n) for n, t in (("grams", _G), ("ml", _ML), ("tsp", _TSP))]
    return lines.groupBy("key").agg(*sums, F.count("*").alias("n_lines"))


def counts(lines: DataFrame) -> DataFrame:
    """(key, counts): array of (unit, n) in order of unit; '' for plain numbers. Garlic without a unit is counted in cloves."""
    bare = F.when(F.col("key") == "garlic", "clove").otherwise("")
    unit = F.when(F.col("unit").isNull(), bare).when(F.col("unit").isin(COUNTED), F.col("unit"))
    by = lines.where("quantity is not null").withColumn("unit", unit).where("unit is not null").groupBy("key", "unit").agg(F.sum("quantity").alias("n"))
    return by.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("unit", "n"))).alias("counts"))  # at most one entry a unit


def amounts(lines: DataFrame) -> DataFrame:
    """(key, amount): '350 g + 1 tbsp + 4 cloves', empty where no line has an amount."""
    both = totals(lines).join(counts(lines), "key", "left")
    plural = {u: measures.UNITS[u][1] for u in COUNTED}

    def counted(c: Column) -> Column:
        word = F.when(c["n"] > 1, measures.lookup(c["unit"], plural)).otherwise(c["unit"])
        return F.concat(measures.nice_number(c["n"]), F.when(c["unit"] == "", "").otherwise(F.concat(F.lit(" "), word)))

    spoons = measures.let(F.col("tsp"), lambda t: F.when(t >= 3, F.concat(measures.nice_number(t / 3), F.lit(" tbsp"))).otherwise(F.concat(measures.nice_number(t), F.lit(" tsp"))))
    some = lambda n, c: F.when(F.col(n) > 0, c)
    parts = [
        some("grams", measures.amount(F.greatest(F.lit(1), measures.round_g(F.col("grams"))), "g")),
        some("ml", measures.amount(F.greatest(F.lit(1), measures.round_ml(F.col("ml"))), "ml")),
        some("tsp", spoons),
    ]
    return both.select("key", F.concat_ws(" + ", *parts, F.transform("counts", counted)).alias("amount"))
