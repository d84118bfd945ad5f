"""Natural keys, keyed state and near-by rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrences(recipes: DataFrame) -> DataFrame:
    """recipes with title_key and occurrence: the place, from 0, among equal titles of a book. Stable over re-reads."""
    keyed = recipes.withColumn("title_key", F.lower(F.trim("title")))
    order = Window.partitionBy("book_id", "title_key").orderBy("created", "id")
    return keyed.withColumn("occurrence", F.row_number().over(order) - 1)


def resolve(keys: DataFrame, recipes: DataFrame) -> DataFrame:
    """Keyed rows with the current id, null where nothing has the key now. Only books with keys are numbered."""
    some = recipes.join(keys.select("book_id").distinct(), "book_id", "left_semi")
    ids = occurrences(some).select("book_id", "title_key", "occurrence", "id")
    return keys.join(ids, ["book_id", "title_key", "occurrence"], "left")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """The newest row of each key; new rows win ties. All columns travel in one struct, so one aggregation does it."""
    names = old.columns
    both = old.withColumn("__new", F.lit(0)).unionByName(new.select(*names).withColumn("__new", F.lit(1)))
    row = F.struct(*names)
    best = both.groupBy(*key).agg(F.max_by(row, F.struct(version, "__new")).alias("row"))
    return best.select("row.*")


def newest(rows: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """The row of each key with the largest version."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), version).alias("row")).select("row.*")


def overlay(rows: DataFrame, edits: DataFrame, key: Sequence[str], schema: str) -> DataFrame:
    """rows with the fields of the corrections' JSON laid over them. A field that is named with null becomes null; one that
    is not named keeps its value. edits: key and fields, one row a key."""
    names = [part.split()[0] for part in schema.split(",")]
    both = rows.join(edits.select(*key, "fields"), list(key), "left")
    said = F.json_object_keys("fields")
    value = F.from_json("fields", schema)
    named = {n: F.when(F.coalesce(F.array_contains(said, n), F.lit(False)), value[n]).otherwise(F.col(n)) for n in names}
    return both.withColumns(named).drop("fields")


def without_keys(old: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    return old.join(gone.select(*key), list(key), "left_anti")


def islands(rows: DataFrame, by: str, order: str, hit: Column, gap: int, least: int) -> DataFrame:
    """(by, first, last, hits): runs of hits at most gap places apart, with at least `least` hits."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    hits = rows.withColumn("place", place).where(hit)
    w = Window.partitionBy(by).orderBy("place")
    new = F.when(F.col("place") - F.lag("place").over(w) > gap, 1).otherwise(0)
    runs = hits.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    out = runs.groupBy(by, "run").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("hits"))
    return out.where(F.col("hits") >= least).drop("run")


def last_before(rows: DataFrame, by: str, order: str, what: Column, reach: int) -> Column:
    """The last non-null value of what on this or the reach rows before."""
    return F.last(what, True).over(Window.partitionBy(by).orderBy(order).rowsBetween(-reach, 0))
