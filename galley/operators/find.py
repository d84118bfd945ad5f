"""The assembled search: every filter that is set, one ranked page of recipes, and the counts beside its filters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.operators import match, text_search
from galley.sources.tables import Star

#: Minutes that a recipe without a time counts as when ordered by time.
NO_TIME = 999_999
# Where a time comes from that a book or a reader stated; kinds of tags for diets and allergens.
STATED = ("label", "labels-summed", "edited")
DIET, ALLERGEN = "diet", "allergen"


@dataclass(frozen=True)
class Search:
    """A request. Filters that are None, empty or false do not apply.

    stated_only, no_long_wait, least_confidence and strict read the columns time_source (one of STATED), long_wait,
    confidence and n_unknown of the recipes. tags: any value within a kind, every kind. diets: every one, free_from: none,
    by tags of the kinds DIET and ALLERGEN; strict: beside one of these two, every ingredient must be known. words look in
    title and section, title_words in the title. order: 'best' (score, then time), 'quickest' (time, then score) or
    'coverage' (coverage, missing, confidence). one_edition: of the same dish in several books one row."""

    pantry: Sequence[str] = ()
    tolerance: int = 0
    relax: bool = False
    words: Sequence[str] = ()
    title_words: Sequence[str] = ()
    max_minutes: int | None = None
    stated_only: bool = False
    no_long_wait: bool = False
    least_confidence: float = 0.0
    strict: bool = False
    tags: dict[str, Sequence[str]] = field(default_factory=dict)
    without_tags: dict[str, Sequence[str]] = field(default_factory=dict)
    diets: Sequence[str] = ()
    free_from: Sequence[str] = ()
    without: Sequence[str] = ()
    author: str = ""
    order: str = "best"
    one_edition: bool = False
    limit: int = 40
    offset: int = 0


def _plain(star: Star, s: Search, favourites: DataFrame | None) -> DataFrame:
    """Recipes that pass what has no facet. Filters on the recipe's own row come first, so that they reach the scan; then
    semi joins."""
    rows = star.recipes
    if s.max_minutes is not None:
        rows = rows.where(F.col("minutes") <= s.max_minutes)
    if s.stated_only:
        rows = rows.where(F.col("time_source").isin(*STATED))
    if s.no_long_wait:
        rows = rows.where("not long_wait")
    if s.least_confidence > 0:
        rows = rows.where(F.col("confidence") >= s.least_confidence)
    if s.words:
        rows = rows.where(text_search.holds(["title", "section"], s.words))
    if s.title_words:
        rows = rows.where(text_search.holds(["title"], s.title_words))
    if s.author:
        books = star.books.where(F.lower("author").contains(s.author.lower())).select(F.col("id").alias("book_id"))
        rows = rows.join(books, "book_id", "left_semi")
    for kind, values in s.without_tags.items():
        rows = match.has_none(rows, star.tags, kind, values)
    if s.without:
        rows = match.without(rows, star, s.without)
    if favourites is not None:
        rows = rows.join(favourites.select("id"), "id", "left_semi")
    return rows


def _counted(star: Star, s: Search, rows: DataFrame) -> DataFrame:
    """rows with what the pantry has of them, as far as it has enough."""
    if not s.pantry:
        return rows.withColumns({"coverage": F.lit(1.0), "missing": F.lit(0).cast("long"), "n_matched": F.lit(0).cast("long")})
    found = match.matched(star, s.pantry).withColumnRenamed("recipe_id", "id").join(rows, "id")
    return match.relaxed(found, s.tolerance) if s.relax else match.within(found, s.tolerance)


def dishes(star: Star) -> DataFrame:
    """(id, dish): the letters and digits of a recipe's title and the sorted names of its ingredients that are no staples."""
    core = star.ingredients.where(~F.col("is_staple")).select(F.col("id").alias("ingredient_id"), "canonical")
    names = star.links.join(core, "ingredient_id").groupBy(F.col("recipe_id").alias("id")).agg(F.sort_array(F.collect_set("canonical")).alias("names"))
    title = F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), r"[^\p{L}\p{N}]", "")
    rows = star.recipes.select("id", title.alias("title")).join(names, "id", "left")
    return rows.select("id", F.struct("title", F.coalesce("names", F.array().cast("array<string>")).alias("names")).alias("dish"))


def one_edition(found: DataFrame, dish: DataFrame, place: Column, favourites: DataFrame | None = None) -> DataFrame:
    """found (id, ...) with one row for each dish (id, dish), and its place: that of the dish's first row, while the row is
    the first one among favourites (id), or the first of all where none is. One aggregation by dish, without a window."""
    names = found.columns
    rows = found.join(dish, "id").withColumn("place", place)
    saved = rows.join(favourites.select("id", F.lit(True).alias("saved")).distinct(), "id", "left") if favourites is not None else rows.withColumn("saved", F.lit(None).cast("boolean"))
    best = F.min_by(F.struct(*names), F.struct(F.col("saved").isNull(), "place")).alias("row")
    return saved.groupBy("dish").agg(F.min("place").alias("place"), best).select("row.*", "place")


def find(star: Star, s: Search, favourites: DataFrame | None = None, saved: DataFrame | None = None) -> DataFrame:
    """(id, score, coverage, missing, minutes): the page that the request asks for. favourites (id): only those. saved (id):
    with one_edition, rows that stand for their dish."""
    rows = match.has_any(_plain(star, s, favourites), star.tags, s.tags)
    if s.diets:
        rows = match.has_all(rows, star.tags, DIET, s.diets)
    if s.free_from:
        rows = match.has_none(rows, star.tags, ALLERGEN, s.free_from)
    if s.strict and (s.diets or s.free_from):
        rows = rows.where("n_unknown = 0")
    found = _counted(star, s, rows)
    score = match.score(F.col("confidence"), F.col("minutes"), F.col("coverage"), F.col("missing"), F.col("n_matched"))
    found = found.withColumn("score", F.round(score, 6))
    time = F.coalesce("minutes", F.lit(NO_TIME))
    orders = {"best": (-F.col("score"), time), "quickest": (time, -F.col("score")), "coverage": (-F.col("coverage"), F.col("missing"), -F.col("confidence"))}
    place = F.struct(*(c.alias(f"o{i}") for i, c in enumerate((*orders[s.order], F.col("id")))))
    found = one_edition(found, dishes(star), place, saved) if s.one_edition else found.withColumn("place", place)
    return found.orderBy("place").offset(s.offset).limit(s.limit).select("id", "score", "coverage", "missing", "minutes")


def facets(star: Star, s: Search, favourites: DataFrame | None = None) -> DataFrame:
    """(kind, value, n): how many recipes the request would find under each tag, each kind counted without the request's own
    choice of that kind. Kinds without a choice count what the request finds.

    The tags of a recipe are met once: a flag says for each chosen kind whether its choice holds, and a tag counts where all
    flags but its own kind's do. relax does not apply: pass the tolerance that the search came to."""
    holds = {k: F.bool_or((F.col("kind") == k) & F.col("value").isin(list(v))) for k, v in s.tags.items() if v}
    if s.diets:
        every = (F.bool_or((F.col("kind") == DIET) & (F.col("value") == d)) for d in set(s.diets))
        holds[DIET] = F.least(*(e.cast("int") for e in every), F.lit(1)) == 1
    if s.free_from:
        holds[ALLERGEN] = ~F.bool_or((F.col("kind") == ALLERGEN) & F.col("value").isin(list(s.free_from)))
    rows = _plain(star, s, favourites)
    known = F.lit(True)
    if s.strict and s.diets:
        rows = rows.where("n_unknown = 0")
    elif s.strict and s.free_from:  # without the allergens' choice nothing is strict
        known = F.col("n_unknown") == 0
    found = _counted(star, s, rows).select("id", known.alias("known"))
    flags = {k: f"holds{i}" for i, k in enumerate(holds)}
    by = star.tags.groupBy(F.col("recipe_id").alias("id")).agg(F.collect_set(F.struct("kind", "value")).alias("tags"), *(c.alias(flags[k]) for k, c in holds.items()))
    met = found.join(by, "id")
    if ALLERGEN in flags:
        met = met.withColumn(flags[ALLERGEN], F.col(flags[ALLERGEN]) & F.col("known"))
    each = met.select(F.explode("tags").alias("t"), *flags.values()).select("t.kind", "t.value", *flags.values())
    for kind, flag in flags.items():
        each = each.where((F.col("kind") == kind) | F.col(flag))
    return each.groupBy("kind", "value").agg(F.count("*").alias("n"))
