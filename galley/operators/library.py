"""What the library holds: suggestions, completions, books by state, headline figures, corrections."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.operators import text_search
from galley.sources.tables import Star


def suggestions(star: Star, typed: str, limit: int = 12) -> DataFrame:
    """(canonical, n): used ingredients whose name holds the typed text; an equal name first, then by use, then length."""
    wanted = typed.strip().lower()
    uses = star.links.groupBy("ingredient_id").agg(F.count("*").alias("uses"))
    named = star.ingredients.where(F.col("canonical").contains(wanted)).join(uses, F.col("id") == F.col("ingredient_id"))
    by = named.groupBy("canonical").agg(F.sum("uses").alias("n"))
    return by.orderBy(F.col("canonical") != wanted, F.desc("n"), F.length("canonical"), "canonical").limit(limit)


def completions(rows: DataFrame, column: str, typed: str, limit: int = 8) -> DataFrame:
    """(value, n): values that hold, for each typed word, a word that begins with it, whatever the case; by count, then
    length, then value. Spellings that differ in case alone are one value, shown as the greatest. Without a typed word the
    first ones in the alphabet. Null values are left out."""
    words = [w for w in re.split(r"[\W_]+", typed) if w]
    found = rows.where(text_search.holds([column], words)) if words else rows.where(F.col(column).isNotNull())
    by = found.groupBy(F.lower(column).alias("folded")).agg(F.max(column).alias("value"), F.count("*").alias("n"))
    order = [F.desc("n"), F.length("value"), "folded"] if words else ["folded"]
    return by.orderBy(*order).limit(limit).select("value", "n")


def containing(rows: DataFrame, column: str, typed: str, limit: int = 8) -> DataFrame:
    """(value, n): values that hold the typed text anywhere, whatever the case, by count, then value: of authors and books
    people remember any part. Null and empty values are left out; an empty text fits all."""
    found = rows.where((F.col(column) != "") & F.lower(column).contains(typed.strip().lower()))
    by = found.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return by.orderBy(F.desc("n"), "value").limit(limit)


def books_by_use(star: Star) -> DataFrame:
    """(book_id, author, title, recipes): every book and its number of recipes, those without any too."""
    n = star.recipes.groupBy("book_id").agg(F.count("*").alias("recipes"))
    books = star.books.withColumnRenamed("id", "book_id").join(n, "book_id", "left")
    return books.select("book_id", "author", "title", F.coalesce("recipes", F.lit(0)).alias("recipes"))


def headline(star: Star) -> DataFrame:
    """One row: books, books without recipes, recipes, authors, titles, ingredients, those in use, staples, links, and
    recipes with a time."""
    used = star.links.select("ingredient_id").distinct().agg(F.count("*").alias("used_ingredients"))
    books = books_by_use(star).agg(
        F.count("*").alias("books"), F.count_if(F.col("recipes") == 0).alias("empty_books"), F.countDistinct("author").alias("authors"), F.countDistinct("title").alias("titles")
    )
    recipes = star.recipes.agg(F.count("*").alias("recipes"), F.count("minutes").alias("timed_recipes"))
    names = star.ingredients.agg(F.count("*").alias("ingredients"), F.count_if("is_staple").alias("staples"))
    links = star.links.agg(F.count("*").alias("links"))
    return books.crossJoin(recipes).crossJoin(names).crossJoin(links).crossJoin(used)  # one row each


def stats(star: Star) -> DataFrame:
    """One row: books read and failed (books.status), recipes, ingredients, links, mean confidence to three places, recipes
    with an image, with a time the book states, with a meal and with a cuisine (tags of these kinds)."""
    books = star.books.agg(F.count_if(F.col("status") == "indexed").alias("books"), F.count_if(F.col("status") == "failed").alias("books_failed"))
    recipes = star.recipes.agg(
        F.count("*").alias("recipes"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("avg_confidence"),
        F.count_if(F.coalesce("image", F.lit("")) != "").alias("with_photo"), F.count_if(F.col("time_source").isin("label", "labels-summed")).alias("timed"),
    )
    of = lambda kind, name: F.countDistinct(F.when(F.col("kind") == kind, F.col("recipe_id"))).alias(name)
    tags = star.tags.where("kind in ('meal', 'cuisine')").agg(of("meal", "tagged"), of("cuisine", "with_cuisine"))
    whole = [star.ingredients.agg(F.count("*").alias("ingredients")), star.links.agg(F.count("*").alias("links")), recipes, tags]
    return reduce(DataFrame.crossJoin, whole, books)  # one row each


def changed(book: DataFrame, now: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(key, changed): names of the fields in which a corrected row differs from the book's, for rows that differ; text is
    compared without white space at its ends."""
    plain = lambda c, kind: F.trim(c) if kind == "string" else c
    kinds = dict(now.dtypes)
    both = now.select(*key, *(F.col(f).alias(f"__{f}") for f in fields)).join(book.select(*key, *fields), list(key))
    names = F.array(*(F.when(~plain(F.col(f), kinds[f]).eqNullSafe(plain(F.col(f"__{f}"), kinds[f])), F.lit(f)) for f in fields))
    return both.select(*key, F.filter(names, lambda x: x.isNotNull()).alias("changed")).where(F.size("changed") > 0)


def correction_totals(changes: DataFrame) -> DataFrame:
    """(field, n): corrected rows by field."""
    return changes.select(F.explode("changed").alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def state(rows: Column, error: Column) -> Column:
    """'failed', 'empty' or 'read' of a book, from its number of recipes and its error."""
    return F.when(error.isNotNull(), "failed").when(F.coalesce(rows, F.lit(0)) == 0, "empty").otherwise("read")
