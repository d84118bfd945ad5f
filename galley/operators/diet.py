"""Diets and allergens of recipes, from tables that class ingredients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes an ingredient may have. 'safe' says only that it is known.
CLASSES = ("meat", "red meat", "fish", "crustacean", "mollusc", "dairy", "egg", "honey", "rennet cheese", "safe")


def known(classes: DataFrame, allergens: DataFrame) -> DataFrame:
    """(canonical, classes, allergens) of every ingredient in either table (canonical, class), (canonical, allergen)."""
    a = classes.groupBy("canonical").agg(F.collect_set("class").alias("classes"))
    b = allergens.groupBy("canonical").agg(F.collect_set("allergen").alias("allergens"))
    none = F.array().cast("array<string>")
    return a.join(b, "canonical", "full").select("canonical", F.coalesce("classes", none).alias("classes"), F.coalesce("allergens", none).alias("allergens"))


def profile(lines: DataFrame, classes: DataFrame, allergens: DataFrame) -> DataFrame:
    """(recipe_id, allergens, unknown, diets, caveats) of recipes, from lines (recipe_id, canonical).

    Diets hold where no known ingredient breaks them; unknown names the ingredients of neither table, so that a strict
    search can leave the recipe out. Arrays are sorted. Lines without a name are ignored."""
    rows = lines.where("canonical is not null").join(known(classes, allergens), "canonical", "left")
    has = lambda *names: F.coalesce(F.bool_or(F.arrays_overlap("classes", F.array(*map(F.lit, names)))), F.lit(False))
    groups = {"meat": ("meat", "red meat"), "red": ("red meat",), "sea": ("fish", "crustacean", "mollusc"), "animal": ("dairy", "egg", "honey")}
    by = rows.groupBy("recipe_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("allergens")))).alias("allergens"),
        F.array_sort(F.collect_set(F.when(F.col("classes").isNull(), F.col("canonical")))).alias("unknown"),
        F.array_sort(F.collect_set(F.when(F.array_contains("classes", "rennet cheese"), F.col("canonical")))).alias("rennet"),
        *(has(*names).alias(n) for n, names in groups.items()),
    )
    vegetarian = ~F.col("meat") & ~F.col("sea")
    diets = {"no red meat": ~F.col("red"), "pescatarian": ~F.col("meat"), "vegan": vegetarian & ~F.col("animal"), "vegetarian": vegetarian}
    some = lambda pairs: F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in pairs.items())), lambda x: x.isNotNull())
    caveat = F.when(vegetarian & (F.size("rennet") > 0), F.concat(F.lit("made with animal rennet: "), F.array_join("rennet", ", ")))
    return by.select("recipe_id", "allergens", "unknown", some(diets).alias("diets"), caveat.alias("caveat"))


def notes(lines: DataFrame, table: DataFrame, profiles: DataFrame) -> DataFrame:
    """(recipe_id, notes): what a reader is told beside the diets, an array in order of rank: of a vegetarian recipe's
    cheeses made with rennet first (the profiles' caveat), then the notes (canonical, rank, note) of its ingredients, each
    once. Recipes without any have an empty array."""
    said = lines.join(table, "canonical").groupBy("recipe_id").agg(F.array_sort(F.collect_set(F.struct("rank", "note"))).alias("n"))
    own = F.coalesce(F.col("n.note"), F.array().cast("array<string>"))
    first = F.filter(F.array("caveat"), lambda c: c.isNotNull())
    return profiles.join(said, "recipe_id", "left").select("recipe_id", F.concat(first, own).alias("notes"))


def fits(found: DataFrame, diets: list[str], without: list[str], strict: bool) -> DataFrame:
    """Recipes that keep every diet and hold none of the allergens; strict also asks that every ingredient is known."""
    keep: Column = F.lit(True)
    for d in diets:
        keep = keep & F.array_contains("diets", d)
    for a in without:
        keep = keep & ~F.array_contains("allergens", a)
    return found.where(keep & (F.size("unknown") == 0) if strict and (diets or without) else keep)
