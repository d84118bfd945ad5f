"""Named queries of the search, diet, shopping and library operators over the driver's tables, and their SQL."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions import nouns, steps
from galley.operators import blocks, diet, find, library, lines, listing, match, names, recipes
from galley.sources import store
from galley.sources.tables import Star, load, star

PANTRY = ["red", "small", "gear"]
_HIT = " OR ".join(f"(' ' || lower(p_name) || ' ') LIKE '% {n} %'" for n in PANTRY)
_LINKS = "links AS (SELECT DISTINCT l_orderkey AS recipe_id, l_partkey AS ingredient_id FROM lineitem)"


def _rich(s: SparkSession, d: str) -> Star:
    """The star with what a reader of books knows of a recipe beside its row."""
    st = star(s, d)
    more = {
        "time_source": F.get(F.array(*map(F.lit, ("estimate", "label", "labels-summed", "edited", "method"))), (F.col("id") % 6).cast("int")), "long_wait": F.col("id") % 7 == 0,
        "confidence": (F.col("id") % 10) / 10, "n_unknown": F.col("id") % 4,
    }
    return Star(st.recipes.withColumns(more), st.books, st.ingredients, st.links, st.tags)


_RICH = """r AS (SELECT o_orderkey AS id, o_custkey AS book_id, o_orderpriority AS title, o_orderstatus AS section, floor(o_totalprice / 1000)::INT AS minutes,
  o_orderkey % 6 IN (1, 2, 3) AS stated, o_orderkey % 7 = 0 AS long_wait, (o_orderkey % 10) / 10 AS confidence, o_orderkey % 4 AS n_unknown FROM orders)"""
_COUNTS = f"""{_LINKS}, c AS (SELECT recipe_id AS id, count(*) FILTER (p_type <> 'ECONOMY') AS n_core, count(*) FILTER (p_type <> 'ECONOMY' AND ({_HIT})) AS n_matched,
  bool_or({_HIT}) AS touched FROM links JOIN part ON p_partkey = ingredient_id GROUP BY recipe_id),
f AS (SELECT id, n_matched, n_core - n_matched AS missing, CASE WHEN n_core > 0 THEN n_matched / n_core ELSE 1.0 END AS coverage FROM c WHERE touched)"""
_MARKS = """m AS (SELECT l_orderkey AS id, bool_or(o_orderpriority IN ('1-URGENT', '5-LOW')) AS cuisine, count(DISTINCT l_linestatus) FILTER (l_linestatus IN ('F', 'O')) = 2 AS diet,
  NOT bool_or(l_returnflag = 'R') AS free FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)"""
_SCORE = "round(100 * coverage - 34 * greatest(0, missing) + 8 * confidence + 6 * CASE WHEN minutes IS NULL THEN 0.0 ELSE greatest(0.0, 1 - minutes / 180) END + least(n_matched, 6), 6)"


def _classes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines (recipe_id, canonical), and ingredients classed by the words of their names."""
    st = star(s, d)
    lines = st.links.join(st.ingredients.select(F.col("id").alias("ingredient_id"), "canonical"), "ingredient_id").select("recipe_id", "canonical")
    first, last = F.split("canonical", " ")[0], F.split("canonical", " ")[1]
    kind = F.when(last == "gear", "meat").when(last == "rod", "fish").when(last == "ring", "dairy").when(last == "bolt", "rennet cheese").when(first != "cold", "safe")
    names_of = st.ingredients.select("canonical").distinct()
    classes = names_of.select("canonical", kind.alias("class")).where("class is not null")
    classes = classes.unionByName(names_of.where("canonical = 'red gear'").withColumn("class", F.lit("red meat")))
    allergen = F.when(last == "plate", "gluten").when(last == "ring", "milk")
    return lines, classes, names_of.select("canonical", allergen.alias("allergen")).where("allergen is not null")


_PROFILE = """l AS (SELECT DISTINCT l_orderkey AS recipe_id, lower(p_name) AS canonical, split_part(lower(p_name), ' ', 1) AS a, split_part(lower(p_name), ' ', 2) AS b
  FROM lineitem JOIN part ON p_partkey = l_partkey),
k AS (SELECT *, b IN ('gear', 'rod', 'ring', 'bolt', 'plate') OR a <> 'cold' AS known FROM l),
p AS (SELECT recipe_id, coalesce(string_agg(DISTINCT CASE b WHEN 'plate' THEN 'gluten' WHEN 'ring' THEN 'milk' END, ',' ORDER BY CASE b WHEN 'plate' THEN 'gluten' WHEN 'ring' THEN 'milk' END), '') AS allergens,
  coalesce(string_agg(DISTINCT canonical, ',' ORDER BY canonical) FILTER (NOT known), '') AS unknown, bool_or(canonical = 'red gear') AS red, bool_or(b = 'gear') AS meat,
  bool_or(b = 'rod') AS sea, bool_or(b = 'ring') AS animal, string_agg(DISTINCT canonical, ', ' ORDER BY canonical) FILTER (b = 'bolt') AS rennet FROM k GROUP BY recipe_id)"""


def _profile(s: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.array_join(c, ",").alias(c)
    return diet.profile(*_classes(s, d)).select("recipe_id", text("allergens"), text("unknown"), text("diets"), "caveat")


def _shopping(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Every eleventh order is listed, at 2 where its key is even; aisles by rules; widgets are ticked."""
    lines = load(s, d, "lineitem").join(load(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    unit = F.when(F.col("l_returnflag") == "R", "g").when(F.col("l_returnflag") == "A", "tbsp").otherwise("cup")
    rows = lines.select(F.col("l_orderkey").alias("recipe_id"), F.lower("p_name").alias("key"), F.col("l_quantity").alias("quantity"), unit.alias("unit"), (F.col("p_type") == "ECONOMY").alias("is_staple"))
    keys = load(s, d, "orders").where("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("recipe_id"))
    changes = keys.select("recipe_id", F.when(F.col("recipe_id") % 2 == 0, 2.0).otherwise(1.0).alias("scale"), F.lit(1).alias("at"))
    wrong = keys.select("recipe_id", F.lit(21.0).alias("scale"), F.lit(2).alias("at"))
    gone = keys.where("recipe_id % 33 = 0").select("recipe_id", F.lit(None).cast("double").alias("scale"), F.lit(3).alias("at"))
    listed = listing.put(s.createDataFrame([], "recipe_id long, scale double"), changes.union(wrong).union(gone))
    rules = s.createDataFrame([(1, "red", "fruit"), (2, "widget", "dairy"), (3, "cold", "frozen"), (4, "gear", "meat")], "rank int, word string, aisle string")
    return listed, rows, rules, rows.select("key").where("key like '% widget'").distinct()


_LISTED = """i AS (SELECT o_orderkey AS recipe_id, CASE WHEN o_orderkey % 2 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS scale FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 33 <> 0),
n AS (SELECT lower(p_name) AS key, l_quantity * scale AS q, l_returnflag AS u, recipe_id, p_type = 'ECONOMY' AS staple FROM i JOIN lineitem ON l_orderkey = recipe_id JOIN part ON p_partkey = l_partkey),
w AS (SELECT key, sum(q) FILTER (u = 'R') AS grams, sum(q * 240) FILTER (u NOT IN ('R', 'A')) AS ml, sum(q * 3) FILTER (u = 'A') AS tsp, count(*) AS n_lines,
  count(DISTINCT recipe_id) AS recipes, bool_or(staple) AS is_staple, key LIKE '% widget' AS ticked,
  CASE WHEN key LIKE 'red %' THEN 'fruit' WHEN key LIKE '% widget' THEN 'dairy' WHEN key LIKE 'cold %' THEN 'frozen' WHEN key LIKE '% gear' THEN 'meat' ELSE 'other' END AS aisle FROM n GROUP BY key)"""

#: Kinds, keys and targets of a small vocabulary in the words of part names.
VOCABULARY = [("exact", "hot rings", "ring set"), ("synonym", "blue widget", "sapphire"), ("noun", "gear", None), ("noun", "red bolt", None), ("noun", "plate", None), ("noise", "old", None), ("noise", "new", None), ("noise", "large", None)]


def _vocabulary(s: SparkSession) -> DataFrame:
    return s.createDataFrame(VOCABULARY, "kind string, key string, target string")


def _named(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "part")
    phrase = F.concat(F.initcap("p_name"), F.when(F.col("p_size") % 2 == 0, "s (sliced)").otherwise(""))
    return names.canonical(rows.select(phrase.alias("phrase")), _vocabulary(s))


def _parted(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "part").withColumn("other", F.when(F.col("p_size") % 3 == 0, " and Gears").when(F.col("p_size") % 3 == 1, " & cheese").otherwise(""))
    return names.parted(rows.select(F.concat("p_name", "other").alias("phrase")), _vocabulary(s))


_NAME = """CASE WHEN {x} = 'blue widget' THEN 'sapphire' WHEN {x} = 'red bolt' THEN 'red bolt' WHEN {x} LIKE '% gear' THEN 'gear' WHEN {x} LIKE '% plate' THEN 'plate'
  ELSE trim(replace(replace(replace(' ' || {x}, ' old ', ' '), ' new ', ' '), ' large ', ' ')) END"""


def _edited(s: SparkSession, d: str) -> DataFrame:
    book = load(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    now = book.withColumns({"title": F.when(F.col("id") % 3 == 0, F.concat("title", F.lit("!"))).otherwise(F.concat(F.lit(" "), "title")), "price": F.when(F.col("id") % 5 == 0, None).otherwise(F.col("price"))})
    return library.changed(book, now, ["id"], ["title", "price", "status"])


def _dietary(s: SparkSession, d: str) -> Star:
    """The star with tags for diets, allergens and cuisines."""
    st = _rich(s, d)
    kind = F.when(F.col("kind") == "flag", find.ALLERGEN).when(F.col("kind") == "status", find.DIET).otherwise("cuisine")
    return Star(st.recipes, st.books, st.ingredients, st.links, st.tags.withColumn("kind", kind))


DIETARY = find.Search(
    pantry=PANTRY, tolerance=2, max_minutes=300, tags={"cuisine": ["1-URGENT", "5-LOW"]}, diets=["F", "O"], free_from=["R"], strict=True, stated_only=True,
    order="quickest", limit=200,
)


def _dietary_found(s: SparkSession, d: str) -> DataFrame:
    star = _dietary(s, d)
    return find.find(star, dataclasses.replace(DIETARY, title_words=["urg"]), star.recipes.where("id % 3 > 0"))


def _facets(s: SparkSession, d: str) -> DataFrame:
    star = _dietary(s, d)
    return find.facets(star, dataclasses.replace(DIETARY, stated_only=False), star.recipes.where("id % 3 > 0"))


def _named_recipes(s: SparkSession, d: str) -> DataFrame:
    st = star(s, d)
    return st.recipes.join(st.books.select(F.col("id").alias("book_id"), "author", F.col("title").alias("book")), "book_id")


def _stats(s: SparkSession, d: str) -> DataFrame:
    st = _rich(s, d)
    kind = F.when(F.col("kind") == "flag", "meal").when(F.col("kind") == "priority", "cuisine").otherwise("diet")
    image = F.when(F.col("id") % 4 == 0, "").when(F.col("id") % 4 == 1, None).otherwise("a.jpg")
    status = F.when(F.col("id") % 10 == 0, "failed").when(F.col("id") % 10 == 1, None).otherwise("indexed")
    return library.stats(Star(st.recipes.withColumn("image", image), st.books.withColumn("status", status), st.ingredients, st.links, st.tags.where("value <> 'N'").withColumn("kind", kind)))


def _one_edition(s: SparkSession, d: str) -> DataFrame:
    """Dishes of one title and one core name, those of every seventh recipe saved."""
    st = _rich(s, d)
    links = st.links.where("position = 1")
    titled = st.recipes.withColumn("title", F.concat(F.col("title"), F.lit("!")))
    return find.find(Star(titled, st.books, st.ingredients, links, st.tags), find.Search(order="quickest", one_edition=True, limit=300), saved=st.recipes.where("id % 7 = 0"))


def _find(order: str, **more) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: find.find(_rich(s, d), find.Search(order=order, **more))


def _steps(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").select("doc_id", steps.split_steps(F.col("text"), None).alias("steps"))


def page_vocabulary(found: DataFrame) -> DataFrame:
    """The words that blocks of at most eight words end with, as names: pages have no word lists of their own."""
    last = F.try_element_at(F.transform(names.words(F.col("text")), nouns.singular), F.lit(-1))
    rows = found.where((F.col("kind") != "image") & (F.size(F.split("text", " ")) <= 8)).select(last.alias("key")).where("key is not null").distinct()
    return rows.select(F.lit("noun").alias("kind"), "key", F.lit(None).cast("string").alias("target"))


def page_blocks(s: SparkSession, d: str) -> DataFrame:
    """Blocks of every page as a book's; ingredient lines are those that score so with the pages' own words."""
    rows = blocks.blocks(load(s, d, "pages"))
    level = F.regexp_extract("tag", "^h([1-6])$", 1).try_cast("int")
    rows = rows.select(F.col("id").alias("book"), "position", "kind", level.alias("level"), F.lit(False).alias("bold"), "text")
    path = store.shared(s, "blocks")  # many steps read the blocks: pages are read once
    lines.mark_lines(rows, page_vocabulary(rows)).write.parquet(path)
    return s.read.parquet(path)


def _pantries(s: SparkSession, d: str) -> DataFrame:
    """A pantry for each word and for each whole name of the parts."""
    part = load(s, d, "part").select(F.lower("p_name").alias("name")).distinct()
    return part.select(F.explode(F.split("name", " ")).alias("name")).union(part).distinct().select(F.concat(F.lit("of "), "name").alias("pantry"), "name")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pantry_batch": lambda s, d: match.matched_many(star(s, d), _pantries(s, d)).where("missing <= 1"),
    "suggest_ingredients": lambda s, d: library.suggestions(star(s, d), "red"),
    "complete_author": lambda s, d: library.containing(_named_recipes(s, d), "author", "#00000001"),
    "complete_book": lambda s, d: library.containing(_named_recipes(s, d), "book", "u", 3),
    "books_by_use": lambda s, d: library.books_by_use(star(s, d)),
    "library_figures": lambda s, d: library.headline(star(s, d)),
    "library_stats": _stats,
    "diet_profile": _profile,
    "diet_strict": lambda s, d: diet.fits(diet.profile(*_classes(s, d)), ["vegetarian"], ["milk"], True).select("recipe_id"),
    "find_best": _find("best", pantry=PANTRY, tolerance=2, max_minutes=150, least_confidence=0.2, no_long_wait=True, tags={"flag": ["R"], "priority": ["1-URGENT", "5-LOW"]}),
    "find_quickest": _find("quickest", words=["low"], stated_only=True, strict=True, without=["cold"], limit=100, offset=5),
    "find_dietary": _dietary_found,
    "facets_of_search": _facets,
    "one_edition_saved": _one_edition,
    "find_relaxed": _find("coverage", pantry=PANTRY, relax=True, author="7", without_tags={"status": ["F"]}, limit=60),
    "shopping_list": lambda s, d: listing.whole(*_shopping(s, d)),
    "shopping_badge": lambda s, d: listing.badge(listing.whole(*_shopping(s, d))),
    "live_ticks": lambda s, d: (lambda listed, rows, _, ticks: listing.live_ticks(ticks, listed.where("recipe_id % 5 = 0"), rows))(*_shopping(s, d)),
    "canonical_names": _named,
    "parted_names": _parted,
    "edited_fields": lambda s, d: _edited(s, d).select("id", F.array_join("changed", ",").alias("changed")),
    "edit_totals": lambda s, d: library.correction_totals(_edited(s, d)),
    "html_blocks": lambda s, d: blocks.blocks(load(s, d, "pages")),
    "method_steps": _steps,
    "page_recipes": lambda s, d: recipes.recipes(page_blocks(s, d)),
}

ORACLE_SQL: dict[str, str] = {
    "pantry_batch": f"""WITH {_LINKS}, w AS (SELECT DISTINCT lower(p_name) AS name FROM part UNION SELECT unnest(string_split(lower(p_name), ' ')) FROM part),
n AS (SELECT recipe_id, count(*) FILTER (p_type <> 'ECONOMY') AS n_core FROM links JOIN part ON p_partkey = ingredient_id GROUP BY 1),
m AS (SELECT name, recipe_id, count(*) FILTER (p_type <> 'ECONOMY') AS n_matched FROM links JOIN part ON p_partkey = ingredient_id JOIN w ON contains(' ' || lower(p_name) || ' ', ' ' || name || ' ') GROUP BY ALL)
SELECT 'of ' || name AS pantry, recipe_id, n_core, n_matched, n_core - n_matched AS missing, CASE WHEN n_core > 0 THEN n_matched / n_core ELSE 1.0 END AS coverage
FROM m JOIN n USING (recipe_id) WHERE n_core - n_matched <= 1""",
    "suggest_ingredients": f"WITH {_LINKS}, u AS (SELECT ingredient_id, count(*) AS k FROM links GROUP BY 1) SELECT lower(p_name) AS canonical, sum(k)::BIGINT AS n FROM part JOIN u ON p_partkey = ingredient_id WHERE lower(p_name) LIKE '%red%' GROUP BY 1 ORDER BY canonical <> 'red', n DESC, length(canonical), canonical LIMIT 12",
    "complete_author": "SELECT c_name AS value, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE lower(c_name) LIKE '%#00000001%' GROUP BY 1 ORDER BY n DESC, value LIMIT 8",
    "complete_book": "SELECT c_mktsegment AS value, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE lower(c_mktsegment) LIKE '%u%' GROUP BY 1 ORDER BY n DESC, value LIMIT 3",
    "books_by_use": "SELECT c_custkey AS book_id, c_name AS author, c_mktsegment AS title, count(o_orderkey) AS recipes FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL",
    "library_stats": f"""WITH {_RICH}, {_LINKS} SELECT (SELECT count(*) FROM customer WHERE c_custkey % 10 > 1) AS books, (SELECT count(*) FROM customer WHERE c_custkey % 10 = 0) AS books_failed,
  count(*) AS recipes, (SELECT count(*) FROM part) AS ingredients, (SELECT count(*) FROM links) AS links, round(avg(confidence), 3) AS avg_confidence, count(*) FILTER (id % 4 > 1) AS with_photo,
  count(*) FILTER (id % 6 IN (1, 2)) AS timed, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_returnflag <> 'N') AS tagged, count(*) AS with_cuisine FROM r""",
    "library_figures": f"""WITH {_LINKS}, b AS (SELECT c_custkey, c_name, c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)
SELECT count(*) AS books, count(*) FILTER (n = 0) AS empty_books, count(DISTINCT c_name) AS authors, count(DISTINCT c_mktsegment) AS titles, (SELECT count(*) FROM orders) AS recipes,
(SELECT count(o_totalprice) FROM orders) AS timed_recipes, (SELECT count(*) FROM part) AS ingredients, (SELECT count(*) FROM part WHERE p_type = 'ECONOMY') AS staples,
(SELECT count(*) FROM links) AS links, (SELECT count(DISTINCT ingredient_id) FROM links) AS used_ingredients FROM b""",
    "diet_profile": f"""WITH {_PROFILE} SELECT recipe_id, allergens, unknown, array_to_string(list_filter([CASE WHEN NOT red THEN 'no red meat' END, CASE WHEN NOT meat THEN 'pescatarian' END,
CASE WHEN NOT meat AND NOT sea AND NOT animal THEN 'vegan' END, CASE WHEN NOT meat AND NOT sea THEN 'vegetarian' END], lambda x: x IS NOT NULL), ',') AS diets,
CASE WHEN NOT meat AND NOT sea AND rennet IS NOT NULL THEN 'made with animal rennet: ' || rennet END AS caveat FROM p""",
    "diet_strict": f"WITH {_PROFILE} SELECT recipe_id FROM p WHERE NOT meat AND NOT sea AND NOT animal AND unknown = ''",
    "find_best": f"""WITH {_RICH}, {_COUNTS} SELECT id, {_SCORE} AS score, coverage, missing, minutes FROM f JOIN r USING (id) WHERE missing <= 2 AND minutes <= 150 AND confidence >= 0.2 AND NOT long_wait
AND title IN ('1-URGENT', '5-LOW') AND id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY score DESC, minutes, id LIMIT 40""",
    "find_quickest": f"""WITH {_RICH}, {_LINKS}, f AS (SELECT *, 1.0::DOUBLE AS coverage, 0::BIGINT AS missing, 0 AS n_matched FROM r)
SELECT id, {_SCORE} AS score, coverage, missing, minutes FROM f WHERE title = '5-LOW' AND stated
AND id NOT IN (SELECT recipe_id FROM links JOIN part ON p_partkey = ingredient_id WHERE lower(p_name) LIKE 'cold %') ORDER BY coalesce(minutes, 999999), score DESC, id LIMIT 100 OFFSET 5""",
    "find_dietary": f"""WITH {_RICH}, {_COUNTS}, {_MARKS} SELECT id, {_SCORE} AS score, coverage, missing, minutes FROM f JOIN r USING (id) JOIN m USING (id)
WHERE missing <= 2 AND minutes <= 300 AND stated AND id % 3 > 0 AND title LIKE '%URG%' AND cuisine AND diet AND free AND n_unknown = 0 ORDER BY minutes, score DESC, id LIMIT 200""",
    "facets_of_search": f"""WITH {_RICH}, {_COUNTS}, {_MARKS}, b AS (SELECT id, cuisine, diet, free, title FROM f JOIN r USING (id) JOIN m USING (id) WHERE missing <= 2 AND minutes <= 300 AND id % 3 > 0 AND n_unknown = 0),
t AS (SELECT DISTINCT l_orderkey AS id, 'allergen' AS kind, l_returnflag AS value FROM lineitem UNION SELECT l_orderkey, 'diet', l_linestatus FROM lineitem UNION ALL SELECT id, 'cuisine', title FROM r)
SELECT kind, value, count(*) AS n FROM b JOIN t USING (id) WHERE (kind = 'cuisine' OR cuisine) AND (kind = 'diet' OR diet) AND (kind = 'allergen' OR free) GROUP BY kind, value""",
    "one_edition_saved": f"""WITH {_RICH}, k AS (SELECT l_orderkey AS id, l_partkey FROM lineitem GROUP BY ALL HAVING min(l_linenumber) = 1),
c AS (SELECT id, string_agg(DISTINCT lower(p_name), '|' ORDER BY lower(p_name)) AS names FROM k JOIN part ON p_partkey = l_partkey WHERE p_type <> 'ECONOMY' GROUP BY id),
s AS (SELECT *, 1.0::DOUBLE AS coverage, 0::BIGINT AS missing, 0 AS n_matched FROM r LEFT JOIN c USING (id)),
w AS (SELECT id, {_SCORE} AS score, coverage, missing, minutes, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') || '|' || coalesce(names, '') AS dish FROM s),
p AS (SELECT *, row_number() OVER (ORDER BY coalesce(minutes, 999999), score DESC, id) AS place FROM w),
q AS (SELECT *, min(place) OVER (PARTITION BY dish) AS first, row_number() OVER (PARTITION BY dish ORDER BY id % 7 <> 0, place) AS nth FROM p)
SELECT id, score, coverage, missing, minutes FROM q WHERE nth = 1 ORDER BY first LIMIT 300""",
    "find_relaxed": f"""WITH {_RICH}, {_COUNTS}, a AS (SELECT f.*, minutes, confidence FROM f JOIN r USING (id) JOIN customer ON c_custkey = book_id WHERE c_name LIKE '%7%'
AND id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')), t AS (SELECT CASE WHEN min(missing) <= 0 THEN 0 WHEN min(missing) <= 2 THEN 2 WHEN min(missing) <= 4 THEN 4 ELSE 99 END AS most FROM a)
SELECT id, {_SCORE} AS score, coverage, missing, minutes FROM a, t WHERE missing <= most ORDER BY coverage DESC, missing, confidence DESC, id LIMIT 60""",
    "shopping_list": f"WITH {_LISTED} SELECT * FROM w",
    "shopping_badge": f"WITH {_LISTED} SELECT aisle, count(*) AS items, count(*) FILTER (NOT ticked) AS left FROM w WHERE NOT is_staple GROUP BY aisle",
    "live_ticks": f"WITH {_LISTED} SELECT DISTINCT key FROM n WHERE key LIKE '% widget' AND recipe_id % 5 = 0",
    "canonical_names": f"""WITH p AS (SELECT DISTINCT lower(p_name) AS x, p_size % 2 = 0 AS many FROM part)
SELECT array_to_string(list_transform(string_split(x, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || CASE WHEN many THEN 's (sliced)' ELSE '' END AS phrase,
CASE WHEN many AND x = 'hot ring' THEN 'ring set' ELSE {_NAME.format(x='x')} END AS canonical FROM p""",
    "parted_names": f"""WITH p AS (SELECT DISTINCT p_name AS x, p_size % 3 AS k FROM part), q AS (SELECT *, {_NAME.format(x='x')} AS name FROM p),
s AS (SELECT *, name IN ('sapphire', 'gear', 'plate', 'red bolt') AS sure FROM q)
SELECT x || ' and Gears' AS phrase, 0 AS position, x AS part, name AS canonical FROM s WHERE k = 0 AND sure UNION ALL
SELECT x || ' and Gears', 1, 'Gears', 'gear' FROM s WHERE k = 0 AND sure UNION ALL
SELECT x || ' and Gears', 0, x || ' and Gears', 'gear' FROM s WHERE k = 0 AND NOT sure UNION ALL
SELECT x || ' & cheese', 0, x || ' & cheese', CASE WHEN x = 'red bolt' THEN 'red bolt' ELSE trim(replace(replace(replace(' ' || x, ' old ', ' '), ' new ', ' '), ' large ', ' ')) || ' cheese' END FROM s WHERE k = 1 UNION ALL
SELECT x, 0, x, name FROM s WHERE k = 2""",
    "edited_fields": "SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'title' END, CASE WHEN o_orderkey % 5 = 0 THEN 'price' END], lambda x: x IS NOT NULL), ',') AS changed FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0",
    "edit_totals": "SELECT 'title' AS field, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'price', count(*) FROM orders WHERE o_orderkey % 5 = 0",
}
