"""Named queries on ingredient lines, and their SQL. Lines are made of every row of lineitem and its part's name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.operators import lines
from galley.sources.tables import load

KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def _named(s: SparkSession, d: str) -> DataFrame:
    part = load(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_name").alias("name"))
    rows = load(s, d, "lineitem").join(part, "l_partkey").withColumn("q", F.col("l_quantity").cast("int"))
    return rows.select(*KEYS, "q", "name", (F.col("l_linenumber") % 6).alias("shape"))


def amounts(s: SparkSession, d: str) -> DataFrame:
    """Lines with amounts in six shapes."""
    q, name = F.col("q"), F.col("name")
    line = (
        F.when(F.col("shape") == 0, F.concat(q, F.lit(" cups "), name, F.lit(", finely sliced")))
        .when(F.col("shape") == 1, F.concat(q, F.lit(" lb ("), q * 454, F.lit(" g) fresh "), name))
        .when(F.col("shape") == 2, F.concat(F.lit("about "), q, F.lit(" to "), q + 1, F.lit(" pints "), name))
        .when(F.col("shape") == 3, F.concat(q, F.lit(" ("), q, F.lit("-oz) cans "), name, F.lit(" (about "), q, F.lit(" cups)")))
        .when(F.col("shape") == 4, F.concat(F.lit("2 x "), q, F.lit(" g "), name)).otherwise(F.concat(q, F.lit(" tbsp "), name, F.lit(" and blue gizmo")))
    )
    return _named(s, d).withColumn("line", line)


def texts(s: SparkSession, d: str) -> DataFrame:
    """Lines that are ingredients, titles, steps and entries of an index."""
    q, name = F.col("q"), F.col("name")
    line = (
        F.when(F.col("shape") == 0, F.concat(q, F.lit(" cups "), name)).when(F.col("shape") == 1, F.initcap(name)).when(F.col("shape") == 2, F.concat(F.lit("stir the "), name, F.lit(" gently")))
        .when(F.col("shape") == 3, F.concat(name, F.lit(", "), q)).when(F.col("shape") == 4, F.concat(q, F.lit(" spare things of steel"))).otherwise(name)
    )
    return _named(s, d).withColumn("line", line)


def vocabulary(s: SparkSession, d: str) -> DataFrame:
    """The parts' names as a vocabulary: those of red things are staples, and some have a weight."""
    names = load(s, d, "part").select(F.lower("p_name").alias("key")).distinct()
    row = lambda kind, target=None: (F.lit(kind).alias("kind"), "key", (F.lit(target) if target is None else target).cast("string").alias("target"))
    noise = s.createDataFrame([("noise", w, None) for w in ("about", "to", "fresh", "cans", "the", "and", "of")], "kind string, key string, target string")
    weights = names.where("key like '% gear' or key like '% rod'").select(*row("grams", 100 + 2 * F.length("key")))
    return names.select(*row("noun")).union(names.where("key like 'red %'").select(*row("staple"))).union(weights).union(noise)


def _scaled(s: SparkSession, d: str) -> DataFrame:
    rows = amounts(s, d)
    return rows.join(lines.scaled_lines(rows, 2.0), "line", "left").select(*KEYS, "line", "scaled", F.coalesce("changed", F.lit(False)).alias("changed"))


def _metric(s: SparkSession, d: str) -> DataFrame:
    rows = amounts(s, d)
    return rows.join(lines.metric_lines(rows, vocabulary(s, d)), "line").select(*KEYS, "line", "metric")


def _parsed(s: SparkSession, d: str) -> DataFrame:
    rows = amounts(s, d)
    read = rows.join(lines.parse_lines(rows, vocabulary(s, d)), "line").select(*KEYS, F.posexplode("ingredients").alias("part", "i"))
    return read.select(*KEYS, "part", "i.*")


def _scored(s: SparkSession, d: str) -> DataFrame:
    rows = texts(s, d)
    return rows.join(lines.score_lines(rows, vocabulary(s, d)), "line").select(*KEYS, "line", "score")


def _first(s: SparkSession, d: str) -> DataFrame:
    rows = amounts(s, d).select(F.col("l_orderkey").alias("recipe"), F.col("l_linenumber").alias("position"), "line")
    return lines.recipe_ingredients(rows, vocabulary(s, d))


_ROWS = "n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::INT AS q, lower(p_name) AS name, l_linenumber % 6 AS shape FROM lineitem JOIN part ON p_partkey = l_partkey)"
_LINES = f"""{_ROWS}, a AS (SELECT *, CASE shape WHEN 0 THEN q || ' cups ' || name || ', finely sliced' WHEN 1 THEN q || ' lb (' || q * 454 || ' g) fresh ' || name
  WHEN 2 THEN 'about ' || q || ' to ' || q + 1 || ' pints ' || name WHEN 3 THEN q || ' (' || q || '-oz) cans ' || name || ' (about ' || q || ' cups)'
  WHEN 4 THEN '2 x ' || q || ' g ' || name ELSE q || ' tbsp ' || name || ' and blue gizmo' END AS line FROM n)"""


def _grams(x: str) -> str:
    return f"(CASE WHEN {x} < 20 THEN round_even({x}, 0) WHEN {x} < 1000 THEN round_even({x} / 5, 0) * 5 ELSE round_even({x} / 25, 0) * 25 END)"


def _ml(x: str) -> str:
    return f"(CASE WHEN {x} < 20 THEN round_even({x}, 0) WHEN {x} < 100 THEN round_even({x} / 5, 0) * 5 WHEN {x} < 1000 THEN round_even({x} / 10, 0) * 10 ELSE round_even({x} / 50, 0) * 50 END)"


def _shown(x: str, unit: str, large: str) -> str:
    return f"(CASE WHEN {x} >= 1000 THEN regexp_replace(format('{{:.2f}}', ({x}) / 1000), '\\.?0+$', '') || ' {large}' ELSE ({x})::BIGINT || ' {unit}' END)"


_KILO = f"round_even({_grams('908.0 * q')} / 50, 0) * 50"
_READ = f"""{_LINES}, p AS (
  SELECT *, 0 AS part, name AS canonical, CASE shape WHEN 1 THEN 'fresh ' || name WHEN 2 THEN line WHEN 3 THEN 'cans ' || name ELSE name END AS display,
    CASE shape WHEN 2 THEN NULL WHEN 4 THEN 2.0 * q ELSE q END::DOUBLE AS quantity, CASE shape WHEN 0 THEN 'cup' WHEN 1 THEN 'lb' WHEN 4 THEN 'g' WHEN 5 THEN 'tbsp' END AS unit,
    CASE shape WHEN 0 THEN 'finely sliced' ELSE '' END AS note, name LIKE 'red %' AS is_staple FROM a
  UNION ALL SELECT *, 1, 'blue gizmo', 'blue gizmo', NULL, NULL, '', false FROM a WHERE shape = 5)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scale_lines": _scaled,
    "lines_to_metric": _metric,
    "parse_lines": _parsed,
    "score_lines": _scored,
    "recipe_ingredients": _first,
}
ORACLE_SQL: dict[str, str] = {
    "scale_lines": f"""WITH {_LINES} SELECT l_orderkey, l_linenumber, l_partkey, line, CASE shape WHEN 0 THEN 2 * q || ' cups ' || name || ', finely sliced'
  WHEN 1 THEN 2 * q || ' lb (' || CASE WHEN 908 * q < 1000 THEN {_shown(_grams('908.0 * q'), 'g', 'kg')} ELSE {_shown(_KILO, 'g', 'kg')} END || ') fresh ' || name
  WHEN 2 THEN 'about ' || 2 * q || ' to ' || 2 * q + 2 || ' pints ' || name WHEN 3 THEN 2 * q || ' (' || q || '-oz) cans ' || name || ' (about ' || 2 * q || ' cups)'
  WHEN 4 THEN '4 x ' || q || ' g ' || name ELSE 2 * q || ' tbsp ' || name || ' and blue gizmo' END AS scaled, true AS changed FROM a""",
    "lines_to_metric": f"""WITH {_LINES} SELECT l_orderkey, l_linenumber, l_partkey, line, CASE shape
  WHEN 0 THEN CASE WHEN name LIKE '% gear' OR name LIKE '% rod' THEN {_shown(_grams('(q * 240.0 / 240 * (100 + 2 * length(name)))'), 'g', 'kg')} ELSE {_shown(_ml('(q * 240.0)'), 'ml', 'l')} END || ' ' || name || ', finely sliced'
  WHEN 1 THEN 454 * q || ' g fresh ' || name WHEN 3 THEN q || ' (' || {_shown(_grams('(q * 28.3495)'), 'g', 'kg')} || ') cans ' || name || ' (about ' || {_shown(_ml('(q * 240.0)'), 'ml', 'l')} || ')' ELSE line END AS metric FROM a""",
    "parse_lines": f"WITH {_READ} SELECT l_orderkey, l_linenumber, l_partkey, part, canonical, display, quantity, unit, note, is_staple FROM p",
    "score_lines": f"""WITH {_ROWS} SELECT l_orderkey, l_linenumber, l_partkey, CASE shape WHEN 0 THEN q || ' cups ' || name WHEN 1 THEN upper(name[1]) || substr(split_part(name, ' ', 1), 2) || ' ' || upper(split_part(name, ' ', 2)[1]) || substr(split_part(name, ' ', 2), 2)
  WHEN 2 THEN 'stir the ' || name || ' gently' WHEN 3 THEN name || ', ' || q WHEN 4 THEN q || ' spare things of steel' ELSE name END AS line,
  (CASE shape WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.05 WHEN 3 THEN 0.0 WHEN 4 THEN 0.6 ELSE 0.5 END)::DOUBLE AS score FROM n""",
    "recipe_ingredients": f"""WITH {_READ}, f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY l_orderkey, canonical ORDER BY l_linenumber, line, part) = 1)
SELECT l_orderkey AS recipe, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, line, part) - 1)::INT AS position, canonical, display, line AS raw, quantity, unit, note, is_staple FROM f""",
}
