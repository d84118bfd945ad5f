"""Named queries on stored state, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley import foods
from galley.operators import edits, text_search
from galley.sources import store
from galley.sources.tables import load


def _interned(s: SparkSession, d: str) -> DataFrame:
    """Ids of all url words of pages, in two batches: even pages first."""
    words = load(s, d, "pages").select("page_id", F.explode(F.split("url", "[^a-z0-9]+")).alias("value")).where("value <> ''")
    bucket = F.ascii("value")
    none = s.createDataFrame([], "id long, value string")
    first = store.intern(none, words.where("page_id % 2 = 0"), bucket)
    return store.intern(first, words, bucket)


def _snapshots(s: SparkSession, d: str) -> DataFrame:
    """Orders by customer in three commits: all, those of every third customer at another price, every seventh gone."""
    rows = load(s, d, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    kept = store.Snapshots(s, store.shared(s, "store"), buckets=16)
    kept.commit("first", rows.where("id % 5 > 0"))
    kept.commit("second", rows.where("book % 3 = 0").withColumn("price", F.col("price") + 1))
    kept.commit("third", rows.limit(0), rows.where("book % 7 = 0").select("book"))
    kept.commit("third", rows)  # known already
    return kept.read()


def _edits(s: SparkSession, d: str) -> DataFrame:
    """Every third order gets another title, every fifth another time, every seventh its own time again."""
    o = load(s, d, "orders")
    versions = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("servings"), F.floor(F.col("o_totalprice") / 1000).cast("int").alias("total_minutes"),
        F.array("o_orderstatus", "o_orderpriority").alias("ingredients"), F.lit("Mix.\nBake.").alias("instructions"), F.lit(30).alias("active_minutes"), F.lit("label").alias("time_source"),
    )
    when = lambda n, x: F.when(F.col("id") % n == 0, x)
    named = F.filter(F.array(when(3, F.lit("title")), F.coalesce(when(5, F.lit("total_minutes")), F.when(F.col("total_minutes") > 0, when(7, F.lit("total_minutes"))))), lambda f: f.isNotNull())
    minutes = F.coalesce(when(5, F.lit("90")), when(7, F.col("total_minutes").cast("string")))
    made = versions.select("id", F.lit(1).alias("at"), named.alias("fields"), F.concat(F.lit(" "), "title", F.lit("!")).alias("title"), "servings", minutes.alias("total_minutes"), "ingredients", "instructions").where(F.size("fields") > 0)
    none = versions.select("id", F.array().cast("array<string>").alias("fields"), *edits.EDITABLE).limit(0)
    kept = edits.save(none, versions, edits.checked(made), ["id"])
    return edits.applied(versions, kept, ["id"]).select("id", "title", "total_minutes", "active_minutes", "time_source", "edited")


def _counts(s: SparkSession, d: str) -> DataFrame:
    """Uses of parts, kept up while every fourth order's lines move to the part before."""
    lines = load(s, d, "lineitem").select(F.col("l_orderkey").alias("recipe"), F.col("l_partkey").alias("ingredient")).distinct()
    stored = lines.groupBy("ingredient").agg(F.count("*").alias("n"))
    before = lines.where("recipe % 4 = 0")
    return edits.counts(stored, before, before.withColumn("ingredient", F.col("ingredient") - 1))


def _indexed(s: SparkSession, d: str) -> DataFrame:
    """Documents that hold words beginning with 'the' and 'and', by a stored index."""
    path = store.shared(s, "words")
    text_search.write_index(load(s, d, "documents"), "doc_id", ["text", "source"], path)
    return text_search.search_index(s, path, ["the", "AND"], "text")


_KINDS = (" cheese", " oil", " powder", " beef", " bread", "")


def _aisles(s: SparkSession, d: str) -> DataFrame:
    """Parts' names made foods, and their aisles."""
    kind = F.get(F.array(*map(F.lit, _KINDS)), F.col("p_size") % len(_KINDS))
    rows = load(s, d, "part").select(F.concat(F.lower("p_name"), kind).alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("n")).select("name", "n", foods.aisle(F.col("name")).alias("aisle"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"interned_ids": _interned, "snapshot_store": _snapshots, "food_aisles": _aisles, "saved_edits": _edits, "kept_counts": _counts, "stored_index": _indexed}
ORACLE_SQL: dict[str, str] = {
    "interned_ids": """WITH w AS (SELECT page_id, unnest(regexp_split_to_array(url, '[^a-z0-9]+')) AS value FROM pages),
f AS (SELECT value, min(page_id % 2) AS late FROM w WHERE value <> '' GROUP BY value)
SELECT row_number() OVER (ORDER BY late, ascii(value), value) AS id, value FROM f""",
    "snapshot_store": """SELECT o_custkey AS book, o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders
WHERE o_custkey % 7 <> 0 AND (o_custkey % 3 = 0 OR o_orderkey % 5 > 0)""",
    "stored_index": "SELECT doc_id AS id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])the') AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])and')",
    "saved_edits": """WITH v AS (SELECT o_orderkey AS id, o_orderpriority AS title, floor(o_totalprice / 1000)::INT AS m FROM orders), t AS (SELECT *, id % 5 = 0 AND m <> 90 AS timed FROM v)
SELECT id, CASE WHEN id % 3 = 0 THEN title || '!' ELSE title END AS title, CASE WHEN timed THEN 90 ELSE m END AS total_minutes, 30 AS active_minutes, CASE WHEN timed THEN 'edited' ELSE 'label' END AS time_source,
  id % 3 = 0 OR timed AS edited FROM t""",
    "kept_counts": """WITH l AS (SELECT DISTINCT l_orderkey AS recipe, l_partkey AS ingredient FROM lineitem),
n AS (SELECT DISTINCT recipe, CASE WHEN recipe % 4 = 0 THEN ingredient - 1 ELSE ingredient END AS ingredient FROM l), a AS (SELECT ingredient FROM l UNION SELECT ingredient FROM n)
SELECT a.ingredient, count(n.recipe) AS n FROM a LEFT JOIN n USING (ingredient) GROUP BY 1""",
    "food_aisles": f"""WITH f AS (SELECT lower(p_name) || [{', '.join(f"'{k}'" for k in _KINDS)}][p_size % {len(_KINDS)} + 1] AS name FROM part)
SELECT name, count(*) AS n, CASE WHEN name LIKE '% cheese' THEN 'Dairy, eggs & chilled' WHEN name LIKE '% oil' THEN 'Oils & vinegars' WHEN name LIKE '% powder' THEN 'Herbs & spices'
  WHEN name LIKE '% beef' THEN 'Meat' WHEN name LIKE '% bread' THEN 'Bakery' ELSE 'Other' END AS aisle FROM f GROUP BY name""",
}
