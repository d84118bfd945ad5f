"""Corrections by hand: checked, kept as differences to the book's version, laid over it again, and counted.

Versions are rows (key..., title, servings, total_minutes, ingredients, instructions, active_minutes, time_source), the book's
own text; corrections are rows (key..., fields, title, servings, total_minutes, ingredients, instructions), where fields names
what is corrected. Keys are natural ones (keyed.occurrences), so that corrections find their recipe after a new reading."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import durations, steps
from galley.operators import lines

EDITABLE = ("title", "servings", "total_minutes", "ingredients", "instructions")
# The longest title, servings text, line and method, most lines, most minutes.
TITLE, SERVINGS, LINE, METHOD, LINES, MINUTES = 200, 60, 500, 50_000, 200, 7 * 24 * 60
# Times that were estimated, and are again when the method is corrected.
ESTIMATED = ("method", "estimate", "unknown")


def _trimmed(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))


def checked(changes: DataFrame) -> DataFrame:
    """changes (key..., fields, the five values; total_minutes as text) tidied, with error: the first reason why one is not
    accepted, else null. A null or blank time takes it away; a field that is not named is null."""
    named = lambda f: F.array_contains("fields", f)
    minutes = F.trim("total_minutes")
    number = minutes.try_cast("int")
    tidy = {
        "title": _trimmed(F.col("title")), "servings": _trimmed(F.col("servings")), "total_minutes": number, "ingredients": _lines(F.col("ingredients")), "instructions": _trimmed(F.col("instructions")),
    }
    given = F.coalesce(minutes, F.lit("")) != ""
    rules = [
        (F.exists("fields", lambda f: ~f.isin(*EDITABLE)), "a field cannot be corrected"), (named("title") & (tidy["title"] == ""), "no title"), (named("title") & (F.length(tidy["title"]) > TITLE), f"title over {TITLE} characters"),
        (named("servings") & (F.length(tidy["servings"]) > SERVINGS), f"servings over {SERVINGS} characters"), (named("total_minutes") & given & number.isNull(), "minutes are no whole number"),
        (named("total_minutes") & given & ~number.between(1, MINUTES), f"minutes not from 1 to {MINUTES}"), (named("ingredients") & (F.size(tidy["ingredients"]) == 0), "no ingredients"),
        (named("ingredients") & (F.size(tidy["ingredients"]) > LINES), f"over {LINES} ingredient lines"), (named("ingredients") & F.exists(tidy["ingredients"], lambda x: F.length(x) > LINE), f"a line over {LINE} characters"),
        (named("instructions") & (F.length(tidy["instructions"]) > METHOD), f"method over {METHOD} characters"),
    ]
    error = F.coalesce(*(F.when(c, F.lit(text)) for c, text in rules))
    return changes.select(*[c for c in changes.columns if c not in EDITABLE], *(F.when(named(f), v).alias(f) for f, v in tidy.items()), error.alias("error"))


def same(field: str, a: Column, b: Column) -> Column:
    """Whether two values of a field mean the same: a method by its steps, lines without blank ones, texts without blanks
    at their ends."""
    of = {"ingredients": _lines, "instructions": lambda c: steps.split_steps(c, None), "total_minutes": lambda c: c}.get(field, _trimmed)
    return of(a).eqNullSafe(of(b))


def save(edits: DataFrame, versions: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """edits after changes (as from checked(), with the order `at`): a named field that means what the book's does is a
    correction no more, others are, and a recipe without any has no row. Of several changes to a recipe the latest counts;
    those with an error, and of recipes that are not there, are left out."""
    good = changes.where("error is null").groupBy(*key).agg(F.max_by(F.struct("fields", *EDITABLE), "at").alias("c"))
    book = versions.select(*key, F.struct(*EDITABLE).alias("b"))
    held = edits.select(*key, F.struct("fields", *EDITABLE).alias("e"))
    rows = held.join(good.join(book, list(key)), list(key), "full")
    says = lambda s, f: F.coalesce(F.array_contains(F.col(f"{s}.fields"), f), F.lit(False))
    value = {f: F.when(says("c", f), F.col(f"c.{f}")).otherwise(F.col(f"e.{f}")) for f in EDITABLE}
    stays = {f: F.when(says("c", f), ~same(f, F.col(f"c.{f}"), F.col(f"b.{f}"))).otherwise(says("e", f)) for f in EDITABLE}
    fields = F.filter(F.array(*(F.when(stays[f], F.lit(f)) for f in EDITABLE)), lambda f: f.isNotNull())
    out = rows.select(*key, fields.alias("fields"), *(F.when(stays[f], value[f]).alias(f) for f in EDITABLE))
    return out.where(F.size("fields") > 0)


def reverted(edits: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    """edits without those of the recipes in gone: the book's version counts again."""
    return edits.join(gone.select(*key), list(key), "left_anti")


def applied(versions: DataFrame, edits: DataFrame, key: Sequence[str]) -> DataFrame:
    """versions as corrected, with edited. A corrected time is 'edited' ('unknown' if taken away), and keeps the active
    minutes only if they fit in; a corrected method of a recipe whose time was estimated is estimated again. After a new
    reading the same edits are laid over the new versions, so that what nobody corrected shows what was read; edits whose
    recipe is gone wait for it."""
    rows = versions.join(edits.select(*key, F.struct("fields", *EDITABLE).alias("e")), list(key), "left")
    said = {f: F.coalesce(F.array_contains("e.fields", f), F.lit(False)) for f in EDITABLE}
    new = {f: F.when(said[f], F.col(f"e.{f}")).otherwise(F.col(f)) for f in EDITABLE}
    again = said["instructions"] & F.col("time_source").isin(*ESTIMATED)
    read = durations.extract_time(F.lit(""), F.col("e.instructions"))
    total = F.when(said["total_minutes"], F.col("e.total_minutes")).when(again, read["total"]).otherwise(F.col("total_minutes"))
    fits = F.when(F.col("active_minutes") <= F.col("e.total_minutes"), F.col("active_minutes"))
    active = F.when(said["total_minutes"], fits).when(again, read["active"]).otherwise(F.col("active_minutes"))
    source = F.when(said["total_minutes"], F.when(F.col("e.total_minutes").isNotNull(), "edited").otherwise("unknown")).when(again, read["source"]).otherwise(F.col("time_source"))
    return rows.select(
        *[c for c in versions.columns if c not in (*EDITABLE, "active_minutes", "time_source")], *(new[f].alias(f) for f in EDITABLE if f != "total_minutes"),
        total.alias("total_minutes"), active.alias("active_minutes"), source.alias("time_source"), F.coalesce(F.size("e.fields") > 0, F.lit(False)).alias("edited"),
    )


def folded(current: DataFrame, vocabulary: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., line): ingredient lines that are no ingredient of their own: a second mention, or a line that names nothing."""
    each = current.select(F.struct(*key).alias("recipe"), F.posexplode("ingredients").alias("position", "line"))
    own = lines.recipe_ingredients(each, vocabulary).select("recipe", F.col("raw").alias("line"))
    return each.select("recipe", "line").join(own, ["recipe", "line"], "left_anti").select("recipe.*", "line")


def counts(stored: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """stored (ingredient, n) after the links (recipe, ingredient) of some recipes changed from before to after: only what
    they hold is taken off and put on. Ingredients that nothing uses keep a row of 0."""
    delta = reduce(DataFrame.unionByName, [t.select("recipe", "ingredient").distinct().select("ingredient", F.lit(d).alias("d")) for t, d in ((before, -1), (after, 1))])
    moved = delta.groupBy("ingredient").agg(F.sum("d").alias("d")).where("d <> 0")
    both = stored.join(moved, "ingredient", "full")
    return both.select("ingredient", (F.coalesce("n", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("n"))
