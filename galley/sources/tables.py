"""The engine's star of tables, and the mapping of the driver's tables to it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Star:
    """recipes (id, book_id, title, section, minutes, created), books (id, author, title), ingredients (id, canonical,
    is_staple), links (recipe_id, ingredient_id, position, quantity), tags (recipe_id, kind, value), whose rows may repeat."""

    recipes: DataFrame
    books: DataFrame
    ingredients: DataFrame
    links: DataFrame
    tags: DataFrame


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def star(spark: SparkSession, sf_dir: str) -> Star:
    orders, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    recipes = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("book_id"), F.col("o_orderpriority").alias("title"),
        F.col("o_orderstatus").alias("section"), F.floor(F.col("o_totalprice") / 1000).cast("int").alias("minutes"), F.col("o_orderdate").alias("created"),
    )
    books = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("author"), F.col("c_mktsegment").alias("title"))
    parts = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.lower("p_name").alias("canonical"), (F.col("p_type") == "ECONOMY").alias("is_staple")
    )
    # Dealt by recipe once: that serves the links' own aggregation and every later one by recipe.
    dealt = lines.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity").repartition("l_orderkey")
    links = dealt.groupBy(F.col("l_orderkey").alias("recipe_id"), F.col("l_partkey").alias("ingredient_id")).agg(
        F.min("l_linenumber").alias("position"), F.sum("l_quantity").alias("quantity")
    )
    # One projection a kind, so that a filter on the kind leaves only its own scan.
    kinds = [(lines, "l_orderkey", "flag", "l_returnflag"), (lines, "l_orderkey", "status", "l_linestatus"), (orders, "o_orderkey", "priority", "o_orderpriority")]
    flat = [t.select(F.col(key).alias("recipe_id"), F.lit(kind).alias("kind"), F.col(value).alias("value")) for t, key, kind, value in kinds]
    tags = flat[0].union(flat[1]).union(flat[2])
    return Star(recipes, books, parts, links, tags)
