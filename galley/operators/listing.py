"""The shopping list: recipes at a scale, what they need by aisle, ticks and extras. All state is rows with keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.operators import shopping

#: The largest scale of a recipe, the longest extra item and their number.
SCALE, LENGTH, ITEMS = 20, 200, 200
OTHER = "other"


def put(listed: DataFrame, changes: DataFrame) -> DataFrame:
    """listed (recipe_id, scale) after changes: a scale over 0 and up to SCALE puts a recipe on or changes it, null takes
    it off, others are ignored. Of several changes to a recipe, that of the largest `at` counts."""
    good = changes.where(f"scale is null or (scale > 0 and scale <= {SCALE})")
    last = good.groupBy("recipe_id").agg(F.max_by(F.struct("scale"), "at").alias("c"))
    both = listed.join(last, "recipe_id", "full")
    scale = F.when(F.col("c").isNull(), F.col("scale")).otherwise(F.col("c.scale"))
    return both.select("recipe_id", scale.alias("new")).where("new is not null").withColumnRenamed("new", "scale")


def needed(listed: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines (recipe_id, key, quantity, unit, is_staple) of the recipes on the list, amounts scaled."""
    return lines.join(listed, "recipe_id").withColumn("quantity", F.col("quantity") * F.col("scale")).drop("scale")


def aisles(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, aisle): the aisle of the first rule (rank, word, aisle) whose word is in the name; OTHER without one. Words
    are met by an equi-join."""
    words = names.select("key", F.explode(F.array_distinct(F.split("key", " "))).alias("word"))
    first = words.join(rules, "word").groupBy("key").agg(F.min_by("aisle", "rank").alias("aisle"))
    return names.select("key").distinct().join(first, "key", "left").select("key", F.coalesce("aisle", F.lit(OTHER)).alias("aisle"))


def whole(listed: DataFrame, lines: DataFrame, rules: DataFrame, ticks: DataFrame) -> DataFrame:
    """(aisle, key, grams, ml, tsp, n_lines, recipes, is_staple, ticked): the list, one row an ingredient."""
    rows = needed(listed, lines)
    sums = shopping.totals(rows)
    use = rows.groupBy("key").agg(F.countDistinct("recipe_id").alias("recipes"), F.bool_or("is_staple").alias("is_staple"))
    marked = ticks.select("key").distinct().withColumn("ticked", F.lit(True))
    out = sums.join(use, "key").join(aisles(use, rules), "key").join(marked, "key", "left")
    return out.withColumn("ticked", F.coalesce("ticked", F.lit(False)))


def badge(whole_list: DataFrame) -> DataFrame:
    """(aisle, items, left): what is on the list, and what is not ticked, by aisle; staples do not count."""
    return whole_list.where("not is_staple").groupBy("aisle").agg(F.count("*").alias("items"), F.count_if(~F.col("ticked")).alias("left"))


def live_ticks(ticks: DataFrame, listed: DataFrame, lines: DataFrame) -> DataFrame:
    """Ticks of what some recipe on the list still needs."""
    return ticks.join(needed(listed, lines).select("key").distinct(), "key", "left_semi")


def add_extras(extras: DataFrame, new: DataFrame) -> DataFrame:
    """extras (name, done, at) and new (name, at): white space folded, blank and too long names left out, the first of
    equal names kept, at most ITEMS by time."""
    name = F.trim(F.regexp_replace("name", r"\s+", " "))
    rows = extras.unionByName(new.select(name.alias("name"), F.lit(False).alias("done"), "at"))
    rows = rows.where((F.col("name") != "") & (F.length("name") <= LENGTH)).groupBy("name").agg(F.min_by(F.struct("done", "at"), "at").alias("r"))
    return rows.select("name", "r.done", "r.at").orderBy("at", "name").limit(ITEMS)
