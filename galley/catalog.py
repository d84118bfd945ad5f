"""Named queries over the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions import classify, durations, measures, nouns, prose, titles
from galley.functions import text as text_functions
from galley.operators import keyed, library, match, shopping, text_search
from galley.plans import lines as line_plans
from galley.plans import recipes as recipe_plans
from galley.plans import stored as stored_plans
from galley.sources.tables import load, star

PANTRY = ["red", "small", "gear", "blue widget"]
CHOSEN = {"flag": ["R", "A"], "priority": ["1-URGENT", "2-HIGH"]}
_LINKS = "links AS (SELECT l_orderkey AS recipe_id, l_partkey AS ingredient_id, min(l_linenumber) AS position, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL)"
_TAGS = """tags AS (SELECT o_orderkey AS recipe_id, 'priority' AS kind, o_orderpriority AS value FROM orders
UNION SELECT l_orderkey, 'flag', l_returnflag FROM lineitem UNION SELECT l_orderkey, 'status', l_linestatus FROM lineitem)"""
_HIT = " OR ".join(f"(' ' || lower(p_name) || ' ') LIKE '% {n} %'" for n in PANTRY)
_MATCHED = f"""{_LINKS}, counts AS (
  SELECT recipe_id, count(*) FILTER (p_type <> 'ECONOMY') AS n_core, count(*) FILTER (p_type <> 'ECONOMY' AND ({_HIT})) AS n_matched,
    bool_or({_HIT}) AS touched FROM links JOIN part ON p_partkey = ingredient_id GROUP BY recipe_id),
found AS (SELECT recipe_id, n_core, n_matched, n_core - n_matched AS missing,
  CASE WHEN n_core > 0 THEN n_matched / n_core ELSE 1.0 END AS coverage FROM counts WHERE touched)"""


def _pantry_match(s: SparkSession, d: str) -> DataFrame:
    st = star(s, d)
    top = match.ranked(match.within(match.matched(st, PANTRY), 1), 40)
    recipes = st.recipes.select(F.col("id").alias("recipe_id"), "title", "minutes", "book_id")
    books = st.books.select(F.col("id").alias("book_id"), "author")
    return top.join(recipes, "recipe_id").join(books, "book_id").drop("book_id")


def _ingredient_lines(s: SparkSession, d: str) -> DataFrame:
    st = star(s, d)
    rows = st.links.join(st.ingredients.select(F.col("id").alias("ingredient_id"), "canonical"), "ingredient_id")
    lines = F.sort_array(F.collect_list(F.struct("position", "ingredient_id", "canonical")))
    return rows.groupBy("recipe_id").agg(F.array_join(F.transform(lines, lambda x: x["canonical"]), "; ").alias("lines"))


def _editions(s: SparkSession, d: str) -> DataFrame:
    docs = load(s, d, "documents")
    return docs.groupBy(F.sha2(F.lower(F.trim("text")), 256).alias("edition")).agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies"))


def _upsert(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "events").select("user_id", "event_id", "event_type", "value")
    old, new = rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")
    return keyed.upsert(old, new, ["user_id", "event_type"], "event_id")


def _favourites(s: SparkSession, d: str) -> DataFrame:
    recipes = star(s, d).recipes
    keys = keyed.occurrences(recipes.where("section = 'F'")).select("book_id", "title_key", "occurrence")
    return keyed.resolve(keys, recipes)


def _last_purchase(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "events")
    what = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return e.select("event_id", keyed.last_before(e, "user_id", "event_id", what, 400).alias("purchase"))


def _pantry_ranked(s: SparkSession, d: str) -> DataFrame:
    st = star(s, d)
    found = match.matched(st, PANTRY).join(st.recipes.select(F.col("id").alias("recipe_id"), "minutes"), "recipe_id")
    scored = found.withColumn("score", match.score(F.lit(1.0), F.col("minutes"), F.col("coverage"), F.col("missing"), F.col("n_matched")))
    return scored.orderBy(F.desc("score"), "recipe_id").limit(40).select("recipe_id", F.round("score", 6).alias("score"))


def _editions_ranked(s: SparkSession, d: str) -> DataFrame:
    rows = star(s, d).recipes.withColumn("edition", F.concat_ws("|", F.lower(F.trim("title")), F.col("book_id")))
    return match.one_per_edition(rows, "edition", [F.coalesce("minutes", F.lit(999999)), "id"]).select("id", "edition")


def _shopping_star(s: SparkSession, d: str) -> DataFrame:
    lines = load(s, d, "lineitem")
    unit = measures.lookup(F.col("l_returnflag"), {"R": "g", "A": "tbsp"})
    return shopping.totals(lines.select(F.col("l_partkey").alias("key"), F.col("l_quantity").alias("quantity"), unit.alias("unit")))


def _overlay(s: SparkSession, d: str) -> DataFrame:
    events = load(s, d, "events")
    edits = keyed.newest(events.select((F.col("user_id")).alias("id"), "event_id", F.col("props").alias("fields")), ["id"], "event_id")
    recipes = star(s, d).recipes.select("id", "title", "minutes", F.col("minutes").alias("k"))
    return keyed.overlay(recipes, edits.select("id", "fields"), ["id"], "k int").select("id", "title", "minutes", "k")


def _quantity() -> dict:
    q = measures.parse_quantity(F.col("x"))
    return {"quantity": q["quantity"], "unit": q["unit"], "rest": q["rest"]}


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pantry_match": _pantry_match,
    "pantry_coverage": lambda s, d: match.matched(star(s, d), PANTRY),
    "pantry_relaxed": lambda s, d: match.relaxed(match.matched(star(s, d), PANTRY), 0),
    "expand_names": lambda s, d: match.expand(star(s, d).ingredients, PANTRY).select("id"),
    "core_counts": lambda s, d: match.core_counts(star(s, d)),
    "facet_counts": lambda s, d: match.facets(star(s, d).tags, CHOSEN),
    "tags_any": lambda s, d: match.has_any(star(s, d).recipes, star(s, d).tags, CHOSEN).select("id"),
    "tags_all": lambda s, d: match.has_all(star(s, d).recipes, star(s, d).tags, "flag", ["R", "N"]).select("id"),
    "tags_none": lambda s, d: match.has_none(star(s, d).recipes, star(s, d).tags, "flag", ["R"]).select("id"),
    "without_ingredient": lambda s, d: match.without(star(s, d).recipes, star(s, d), ["red"]).select("id"),
    "time_cap": lambda s, d: star(s, d).recipes.where("minutes <= 60").select("id", "minutes"),
    "author_like": lambda s, d: (st := star(s, d)).recipes.join(st.books.where(F.col("author").ilike("%01%")).select(F.col("id").alias("book_id"), "author"), "book_id").select("id", "author"),
    "quickest": lambda s, d: star(s, d).recipes.orderBy(F.coalesce("minutes", F.lit(999999)), "id").limit(25).select("id", "minutes"),
    "ingredient_use": lambda s, d: star(s, d).links.groupBy("ingredient_id").agg(F.count("*").alias("n_recipes")),
    "popular_ingredients": lambda s, d: (st := star(s, d)).links.groupBy("ingredient_id").agg(F.count("*").alias("n")).join(st.ingredients.where("not is_staple").select(F.col("id").alias("ingredient_id"), "canonical"), "ingredient_id").orderBy(F.desc("n"), "ingredient_id").limit(24),
    "tag_counts": lambda s, d: star(s, d).tags.distinct().groupBy("kind", "value").agg(F.count("*").alias("n")),
    "headline_stats": lambda s, d: star(s, d).recipes.agg(F.count("*").alias("recipes"), F.countDistinct("book_id").alias("books"), F.count_if(F.col("minutes") <= 30).alias("quick"), F.max("minutes").alias("longest")),
    "by_author": lambda s, d: (st := star(s, d)).recipes.join(st.books.select(F.col("id").alias("book_id"), "author"), "book_id").groupBy("author").agg(F.count("*").alias("n")),
    "title_groups": lambda s, d: star(s, d).books.groupBy(F.lower("title").alias("folded")).agg(F.max("title").alias("title"), F.count("*").alias("n")),
    "occurrence_keys": lambda s, d: keyed.occurrences(star(s, d).recipes).select("id", "book_id", "title_key", "occurrence"),
    "favourites_resolved": _favourites,
    "upsert_newest": _upsert,
    "ingredient_lines": _ingredient_lines,
    "edition_groups": _editions,
    "full_text_all": lambda s, d: text_search.search(load(s, d, "documents"), "doc_id", "text", ["the", "and"]),
    "full_text_prefix": lambda s, d: text_search.search(load(s, d, "documents"), "doc_id", "text", ["ein", "ver"]),
    "cache_names": lambda s, d: load(s, d, "pages").select("page_id", text_functions.cache_name(F.col("url"), F.col("page_id").cast("string")).alias("name")),
    "last_purchase": _last_purchase,
    "purchase_runs": lambda s, d: keyed.islands(load(s, d, "events"), "user_id", "event_id", F.col("event_type") == "purchase", 3, 3),
    "quantity_by_ingredient": lambda s, d: load(s, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"), F.countDistinct("l_orderkey").alias("recipes")),
    "pantry_ranked": _pantry_ranked,
    "one_per_edition": _editions_ranked,
    "shopping_totals": _shopping_star,
    "edits_overlay": _overlay,
    "round_measures": lambda s, d: load(s, d, "lineitem").select("l_orderkey", "l_linenumber", measures.round_g(F.col("l_extendedprice")).alias("g"), measures.round_ml(F.col("l_quantity") * 2.5).alias("ml")),
    "metric_lines": lambda s, d: load(s, d, "lineitem").select("l_orderkey", "l_linenumber", measures.to_metric(F.col("l_quantity"), F.lit("lb"), F.lit(None)).alias("metric")),
    "nice_numbers": lambda s, d: load(s, d, "lineitem").select("l_quantity").distinct().select("l_quantity", measures.nice_number(F.col("l_quantity") / 4).alias("written")),
    "conversation_text": lambda s, d: load(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), " · ").alias("text")),
    "complete_title": lambda s, d: library.completions(star(s, d).ingredients, "canonical", "b").withColumnRenamed("value", "canonical"),
}


def _lines(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, line, x): every line of every document; a null text is one null line."""
    pieces = F.split("text", "\n", -1)
    return load(s, d, "documents").select("doc_id", F.posexplode(F.coalesce(pieces, F.array(F.lit(None).cast("string")))).alias("line", "x"))


def _by_line(column: Callable[[], dict]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: _lines(s, d).select("doc_id", "line", *(c.alias(n) for n, c in column().items()))


def _by_text(column: Callable[[], dict]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: load(s, d, "documents").select("doc_id", F.col("text").alias("x"), F.split("text", "\n", -1)[0].alias("head"), "source").select("doc_id", *(c.alias(n) for n, c in column().items()))


def _classes() -> dict:
    parts = F.col("head"), F.col("source"), F.transform(F.split("x", "[\n,]"), lambda w: F.lower(F.trim(w)))
    return {"meals": F.array_join(classify.meals(*parts), ", "), "cuisine": classify.cuisine(*parts)["cuisine"]}


def _singulars(s: SparkSession, d: str) -> DataFrame:
    words = load(s, d, "documents").select(F.explode_outer(F.split("text", "\\s+")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).select("word", "n", nouns.singular(F.col("word")).alias("singular"))


#: Functions of recipe lines over all lines or texts of documents; tests/test_whole.py holds them against plain Python.
WHOLE: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parse_quantity": _by_line(_quantity),
    "extract_time": _by_text(lambda: {n: durations.extract_time(F.col("head"), F.col("x"))[n] for n in ("total", "source", "long_wait")}),
    "find_timers": _by_line(lambda: {"labels": F.array_join(F.transform(durations.find_timers(F.col("x")), lambda t: t["label"]), ", ")}),
    "scale_servings": _by_line(lambda: {"base": measures.servings_base(F.col("x")), "doubled": measures.scale_servings(F.col("x"), 2)}),
    "printed_metric": _by_line(lambda: {"metric": measures.printed_metric(F.col("x"))}),
    "classify_recipes": _by_text(_classes),
    "diagnose_errors": _by_text(lambda: {n: classify.diagnose(F.col("x"))[n] for n in ("retry", "cause")}),
    "display_titles": _by_line(lambda: {"shown": titles.display_title(F.col("x"))}),
    "convert_prose": _by_text(lambda: {"metric": prose.convert_text(F.col("x"))}),
    "singular_words": _singulars,
}

ORACLE_SQL: dict[str, str] = {
    "pantry_match": f"""WITH {_MATCHED}, top AS (SELECT * FROM found WHERE missing <= 1 ORDER BY coverage DESC, missing, recipe_id LIMIT 40)
SELECT recipe_id, n_core, n_matched, missing, coverage, o_orderpriority AS title, floor(o_totalprice / 1000)::INT AS minutes, c_name AS author
FROM top JOIN orders ON o_orderkey = recipe_id JOIN customer ON c_custkey = o_custkey""",
    "pantry_coverage": f"WITH {_MATCHED} SELECT * FROM found",
    "pantry_relaxed": f"""WITH {_MATCHED}, t AS (SELECT min(missing) AS m FROM found)
SELECT found.* FROM found, t WHERE missing <= CASE WHEN m <= 0 THEN 0 WHEN m <= 2 THEN 2 WHEN m <= 4 THEN 4 ELSE 99 END""",
    "expand_names": f"SELECT p_partkey AS id FROM part WHERE {_HIT}",
    "core_counts": f"WITH {_LINKS} SELECT recipe_id, count(*) FILTER (p_type <> 'ECONOMY') AS n_core, count(*) AS n_links FROM links JOIN part ON p_partkey = ingredient_id GROUP BY recipe_id",
    "facet_counts": f"""WITH {_TAGS}, f AS (SELECT recipe_id, bool_or(kind = 'flag' AND value IN ('R', 'A')) AS a, bool_or(kind = 'priority' AND value IN ('1-URGENT', '2-HIGH')) AS b FROM tags GROUP BY recipe_id)
SELECT kind, value, count(*) AS n FROM tags JOIN f USING (recipe_id) WHERE (kind = 'flag' OR a) AND (kind = 'priority' OR b) GROUP BY kind, value""",
    "tags_any": f"WITH {_TAGS} SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT recipe_id FROM tags WHERE kind = 'flag' AND value IN ('R', 'A')) AND o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "tags_all": "SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N')",
    "tags_none": "SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
    "without_ingredient": "SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey AND (' ' || lower(p_name) || ' ') LIKE '% red %')",
    "time_cap": "SELECT o_orderkey AS id, floor(o_totalprice / 1000)::INT AS minutes FROM orders WHERE floor(o_totalprice / 1000) <= 60",
    "author_like": "SELECT o_orderkey AS id, c_name AS author FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_name ILIKE '%01%'",
    "quickest": "SELECT o_orderkey AS id, floor(o_totalprice / 1000)::INT AS minutes FROM orders ORDER BY 2, 1 LIMIT 25",
    "ingredient_use": "SELECT l_partkey AS ingredient_id, count(DISTINCT l_orderkey) AS n_recipes FROM lineitem GROUP BY 1",
    "popular_ingredients": "SELECT l_partkey AS ingredient_id, count(DISTINCT l_orderkey) AS n, lower(p_name) AS canonical FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type <> 'ECONOMY' GROUP BY ALL ORDER BY n DESC, 1 LIMIT 24",
    "tag_counts": f"WITH {_TAGS} SELECT kind, value, count(*) AS n FROM tags GROUP BY kind, value",
    "headline_stats": "SELECT count(*) AS recipes, count(DISTINCT o_custkey) AS books, count(*) FILTER (floor(o_totalprice / 1000) <= 30) AS quick, max(floor(o_totalprice / 1000))::INT AS longest FROM orders",
    "by_author": "SELECT c_name AS author, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1",
    "title_groups": "SELECT lower(c_mktsegment) AS folded, max(c_mktsegment) AS title, count(*) AS n FROM customer GROUP BY 1",
    "occurrence_keys": "SELECT o_orderkey AS id, o_custkey AS book_id, lower(trim(o_orderpriority)) AS title_key, (row_number() OVER (PARTITION BY o_custkey, lower(trim(o_orderpriority)) ORDER BY o_orderdate, o_orderkey) - 1)::INT AS occurrence FROM orders",
    "favourites_resolved": """WITH k AS (SELECT o_custkey AS book_id, lower(trim(o_orderpriority)) AS title_key, (row_number() OVER (PARTITION BY o_custkey, lower(trim(o_orderpriority)) ORDER BY o_orderdate, o_orderkey) - 1)::INT AS occurrence FROM orders WHERE o_orderstatus = 'F'),
r AS (SELECT o_custkey AS book_id, lower(trim(o_orderpriority)) AS title_key, (row_number() OVER (PARTITION BY o_custkey, lower(trim(o_orderpriority)) ORDER BY o_orderdate, o_orderkey) - 1)::INT AS occurrence, o_orderkey AS id FROM orders)
SELECT * FROM k LEFT JOIN r USING (book_id, title_key, occurrence)""",
    "upsert_newest": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "ingredient_lines": f"WITH {_LINKS} SELECT recipe_id, string_agg(lower(p_name), '; ' ORDER BY position, ingredient_id) AS lines FROM links JOIN part ON p_partkey = ingredient_id GROUP BY recipe_id",
    "edition_groups": "SELECT sha256(lower(trim(text))) AS edition, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY 1",
    "full_text_all": "SELECT doc_id AS id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])the') AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])and')",
    "full_text_prefix": "SELECT doc_id AS id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])ein') AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])ver')",
    "cache_names": "SELECT page_id, substr(sha256(url || '|' || page_id), 1, 20) AS name FROM pages",
    "last_purchase": "SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 400 PRECEDING AND CURRENT ROW) AS purchase FROM events",
    "purchase_runs": """WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS place FROM events),
h AS (SELECT user_id, place, CASE WHEN place - lag(place) OVER (PARTITION BY user_id ORDER BY place) > 3 THEN 1 ELSE 0 END AS new FROM p WHERE event_type = 'purchase'),
r AS (SELECT user_id, place, sum(new) OVER (PARTITION BY user_id ORDER BY place) AS run FROM h)
SELECT user_id, min(place) AS first, max(place) AS last, count(*) AS hits FROM r GROUP BY user_id, run HAVING count(*) >= 3""",
    "quantity_by_ingredient": "SELECT l_partkey, sum(l_quantity) AS quantity, count(DISTINCT l_orderkey) AS recipes FROM lineitem GROUP BY 1",
    "pantry_ranked": f"""WITH {_MATCHED}, s AS (SELECT recipe_id, 100 * coverage - 34 * missing + 8 + 6 * greatest(0, 1 - floor(o_totalprice / 1000) / 180) + 6 * least(n_matched, 6) / 6 AS score
FROM found JOIN orders ON o_orderkey = recipe_id) SELECT recipe_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, recipe_id LIMIT 40""",
    "one_per_edition": """SELECT o_orderkey AS id, lower(trim(o_orderpriority)) || '|' || o_custkey AS edition FROM orders
QUALIFY row_number() OVER (PARTITION BY lower(trim(o_orderpriority)), o_custkey ORDER BY floor(o_totalprice / 1000), o_orderkey) = 1""",
    "shopping_totals": """SELECT l_partkey AS key, sum(l_quantity) FILTER (l_returnflag = 'R') AS grams, NULL::DOUBLE AS ml, sum(3 * l_quantity) FILTER (l_returnflag = 'A') AS tsp,
count(*) AS n_lines FROM lineitem GROUP BY 1""",
    "edits_overlay": """WITH e AS (SELECT user_id AS id, (props->>'k')::INT AS k FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT o_orderkey AS id, o_orderpriority AS title, floor(o_totalprice / 1000)::INT AS minutes, CASE WHEN e.id IS NULL THEN floor(o_totalprice / 1000)::INT ELSE e.k END AS k FROM orders LEFT JOIN e ON e.id = o_orderkey""",
    "round_measures": """WITH v AS (SELECT *, l_quantity * 2.5 AS m, CASE WHEN l_extendedprice < 20 THEN 1 WHEN l_extendedprice < 1000 THEN 5 ELSE 25 END AS sg,
CASE WHEN l_quantity * 2.5 < 20 THEN 1 WHEN l_quantity * 2.5 < 100 THEN 5 WHEN l_quantity * 2.5 < 1000 THEN 10 ELSE 50 END AS sm FROM lineitem)
SELECT l_orderkey, l_linenumber, (round_even(l_extendedprice / sg, 0) * sg)::BIGINT AS g, (round_even(m / sm, 0) * sm)::BIGINT AS ml FROM v""",
    "metric_lines": """WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity * 453.592 AS x FROM lineitem),
r AS (SELECT *, (CASE WHEN x < 20 THEN round_even(x, 0) WHEN x < 1000 THEN round_even(x / 5, 0) * 5 ELSE round_even(x / 25, 0) * 25 END)::BIGINT AS g FROM v)
SELECT l_orderkey, l_linenumber, CASE WHEN g >= 1000 THEN regexp_replace(format('{:.2f}', g / 1000), '\\.?0+$', '') || ' kg' ELSE g || ' g' END AS metric FROM r""",
    "nice_numbers": """WITH v AS (SELECT DISTINCT l_quantity, l_quantity / 4 AS x FROM lineitem)
SELECT l_quantity, CASE WHEN x >= 20 THEN round_even(x, 0)::INT::VARCHAR WHEN x >= 10 THEN floor(round_even(x * 2, 0) / 2)::INT::VARCHAR || CASE WHEN round_even(x * 2, 0)::INT % 2 = 1 THEN '½' ELSE '' END
ELSE CASE WHEN x < 1 THEN '' ELSE floor(x)::INT::VARCHAR END || CASE x - floor(x) WHEN 0.25 THEN '¼' WHEN 0.5 THEN '½' WHEN 0.75 THEN '¾' ELSE '' END END AS written FROM v""",
    "conversation_text": "SELECT conv_id, string_agg(coalesce(text, ''), ' · ' ORDER BY turn, coalesce(text, '')) AS text FROM conversations GROUP BY 1",
    "complete_title": "SELECT lower(p_name) AS canonical, count(*) AS n FROM part WHERE lower(p_name) LIKE 'b%' OR lower(p_name) LIKE '% b%' GROUP BY 1 ORDER BY n DESC, length(canonical), canonical LIMIT 8",
}

QUERIES |= WHOLE | recipe_plans.QUERIES | line_plans.QUERIES | stored_plans.QUERIES
ORACLE_SQL |= recipe_plans.ORACLE_SQL | line_plans.ORACLE_SQL | stored_plans.ORACLE_SQL
