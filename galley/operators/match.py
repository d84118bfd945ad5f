"""Inventory match: which recipes can be made from what is there, and the filters around it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.sources.tables import Star


def expand(ingredients: DataFrame, names: Sequence[str]) -> DataFrame:
    """(id, name): ingredients whose canonical name is, or contains as whole words, one of names; the first name that
    claims an ingredient keeps it. Runs of words are exploded and met by an equi-join, not compared with LIKE."""
    wanted = list(dict.fromkeys(n.strip().lower() for n in names if n.strip()))
    spark = ingredients.sparkSession
    table = spark.createDataFrame([(n, i) for i, n in enumerate(wanted)], "name string, rank int")
    longest = max((len(n.split(" ")) for n in wanted), default=1)
    words = F.split("canonical", " ")
    runs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size(words)),
            lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - i + 1)), lambda n: F.array_join(F.slice(words, i, n), " ")),
        )
    )
    found = ingredients.select("id", F.explode(F.array_distinct(runs)).alias("name")).join(F.broadcast(table), "name")  # names typed by a user
    return found.groupBy("id").agg(F.min_by("name", "rank").alias("name"))


def core_counts(star: Star) -> DataFrame:
    """(recipe_id, n_core, n_links): ingredients that are not staples, and all."""
    joined = star.links.join(star.ingredients.select(F.col("id").alias("ingredient_id"), "is_staple"), "ingredient_id")
    return joined.groupBy("recipe_id").agg(F.count_if(~F.col("is_staple")).alias("n_core"), F.count("*").alias("n_links"))


def matched(star: Star, names: Sequence[str]) -> DataFrame:
    """(recipe_id, n_core, n_matched, missing, coverage) of recipes that use a named ingredient. One pass over the links:
    matches and core ingredients are counted by the same aggregation. Staples never count."""
    pantry = expand(star.ingredients, names).select(F.col("id").alias("ingredient_id"), F.lit(True).alias("have"))
    known = star.ingredients.select(F.col("id").alias("ingredient_id"), "is_staple").join(pantry, "ingredient_id", "left")
    joined = star.links.join(known, "ingredient_id")
    core, have = ~F.col("is_staple"), F.coalesce("have", F.lit(False))
    counts = joined.groupBy("recipe_id").agg(
        F.count_if(core).alias("n_core"), F.count_if(core & have).alias("n_matched"), F.bool_or(have).alias("touched")
    )
    missing = F.col("n_core") - F.col("n_matched")
    return counts.where("touched").select(
        "recipe_id", "n_core", "n_matched", missing.alias("missing"),
        F.when(F.col("n_core") > 0, F.col("n_matched") / F.col("n_core")).otherwise(1.0).alias("coverage"),
    )


def matched_many(star: Star, pantries: DataFrame) -> DataFrame:
    """matched() of many pantries at once: (pantry, recipe_id, n_core, n_matched, missing, coverage) from rows (pantry, name).

    Names meet the ingredients' runs of words by one equi-join; a recipe's core count is made once and shared by all
    pantries; only links of an ingredient that some pantry holds are met."""
    longest = pantries.agg(F.max(F.size(F.split(F.trim("name"), " ")))).first()[0] or 1
    words = F.split("canonical", " ")
    runs = F.flatten(
        F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - i + 1)), lambda n: F.array_join(F.slice(words, i, n), " ")))
    )
    wanted = pantries.select("pantry", F.lower(F.trim("name")).alias("name")).where("name <> ''").distinct()
    named = star.ingredients.select(F.col("id").alias("ingredient_id"), "is_staple", F.explode(F.array_distinct(runs)).alias("name"))
    held = named.join(wanted, "name").select("pantry", "ingredient_id", "is_staple").distinct()
    hits = star.links.select("recipe_id", "ingredient_id").join(held, "ingredient_id")
    hits = hits.groupBy("pantry", "recipe_id").agg(F.count_if(~F.col("is_staple")).alias("n_matched"))
    found = hits.join(core_counts(star).select("recipe_id", "n_core"), "recipe_id")
    coverage = F.when(F.col("n_core") > 0, F.col("n_matched") / F.col("n_core")).otherwise(1.0)
    return found.select("pantry", "recipe_id", "n_core", "n_matched", (F.col("n_core") - F.col("n_matched")).alias("missing"), coverage.alias("coverage"))


def within(found: DataFrame, tolerance: int) -> DataFrame:
    return found.where(F.col("missing") <= max(0, tolerance))


def relaxed(found: DataFrame, tolerance: int, steps: Sequence[int] = (0, 2, 4, 99)) -> DataFrame:
    """within() the smallest of tolerance + step that has a hit: the counts are made once, not once a step."""
    low = found.agg(F.min("missing")).scalar()
    fits = F.least(*(F.when(low <= max(0, tolerance) + s, F.lit(max(0, tolerance) + s)) for s in steps), F.lit(2**30))
    return found.where(F.col("missing") <= fits)


def ranked(found: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Best coverage first, then fewest missing, then id."""
    return found.orderBy(F.desc("coverage"), "missing", "recipe_id").offset(offset).limit(limit)


def score(confidence: Column, minutes: Column, coverage: Column, missing: Column, n_matched: Column) -> Column:
    """Rank of a matched recipe: coverage first, then few missing, trust in the reading, little time, many matches."""
    quick = F.when(minutes.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - minutes / 180))
    return 100 * coverage - 34 * F.greatest(F.lit(0), missing) + 8 * confidence + 6 * quick + F.least(n_matched, F.lit(6))


def one_per_edition(rows: DataFrame, edition: str, order: Sequence[Column | str]) -> DataFrame:
    """The first row of each edition by order; rows without an edition all stay. One aggregation with partial results, so
    an edition that holds a third of all rows is no hot group."""
    names = rows.columns
    first = rows.where(F.col(edition).isNotNull()).groupBy(edition).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("row")).select("row.*")
    return first.unionByName(rows.where(F.col(edition).isNull()))


def has_any(recipes: DataFrame, tags: DataFrame, wanted: dict[str, Sequence[str]]) -> DataFrame:
    """Any value within a kind, and every kind: a semi join for each, all by the recipe's id. The kind and its values reach
    the scan, and tags need no deduplication for it."""
    for kind, values in wanted.items():
        hit = tags.where((F.col("kind") == kind) & F.col("value").isin(list(values))).select(F.col("recipe_id").alias("id"))
        recipes = recipes.join(hit, "id", "left_semi")
    return recipes


def has_all(recipes: DataFrame, tags: DataFrame, kind: str, values: Sequence[str]) -> DataFrame:
    """Every value of a kind."""
    hit = tags.where((F.col("kind") == kind) & F.col("value").isin(list(values))).groupBy(F.col("recipe_id").alias("id"))
    return recipes.join(hit.agg(F.countDistinct("value").alias("n")).where(F.col("n") == len(set(values))), "id", "left_semi")


def has_none(recipes: DataFrame, tags: DataFrame, kind: str, values: Sequence[str]) -> DataFrame:
    bad = tags.where((F.col("kind") == kind) & F.col("value").isin(list(values))).select(F.col("recipe_id").alias("id"))
    return recipes.join(bad, "id", "left_anti")


def without(recipes: DataFrame, star: Star, names: Sequence[str]) -> DataFrame:
    """Recipes that use none of the named ingredients."""
    bad = star.links.join(expand(star.ingredients, names).select(F.col("id").alias("ingredient_id")), "ingredient_id")
    return recipes.join(bad.select(F.col("recipe_id").alias("id")), "id", "left_anti")


def facets(tags: DataFrame, chosen: dict[str, Sequence[str]]) -> DataFrame:
    """(kind, value, n): recipes by tag, each kind under the choices of all other kinds but not its own. One scan: a
    recipe has a flag for each chosen kind, and a tag counts where all flags but its own kind's hold."""
    flags = {k: F.bool_or((F.col("kind") == k) & F.col("value").isin(list(v))) for k, v in chosen.items()}
    by = tags.groupBy("recipe_id").agg(F.collect_set(F.struct("kind", "value")).alias("tags"), *(c.alias(f"has_{k}") for k, c in flags.items()))
    rows = by.select(F.explode("tags").alias("t"), *(f"has_{k}" for k in chosen)).select("t.kind", "t.value", *(f"has_{k}" for k in chosen))
    keep: Column = F.lit(True)
    for k in chosen:
        keep = keep & ((F.col("kind") == k) | F.col(f"has_{k}"))
    return rows.where(keep).groupBy("kind", "value").agg(F.count("*").alias("n"))
