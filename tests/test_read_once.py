"""Lines that repeat are read once: nothing that reads a line stands where the rows are, before they are distinct."""

import pytest
from pyspark.sql import functions as F

from galley.operators import lines
from galley.plans import lines as plans

#: Stands in every line.
MARK = "marked"
READING = ("RLIKE", "regexp_", "replace(", "translate(", "split(", "transform(")


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([("noun", f"{MARK} rice", None), ("noise", "about", None), ("grams", f"{MARK} rice", "200")], "kind string, key string, target string").cache()


@pytest.fixture(scope="module")
def rows(spark):
    """3,000 rows of 7 lines, one of them null."""
    line = F.when(F.col("shape") < 6, F.concat("shape", F.lit(f" cups {MARK} rice, rinsed")))
    return spark.range(3000).withColumn("shape", F.col("id") % 7).select("id", line.alias("line"))


def read_by_row(frame, mark=f" cups {MARK} rice"):
    """The nodes of the plan that read the line of each row: a part of every line stands in them, and a function that reads."""
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert mark in plan
    return [n for n in plan.split("\n") if mark in n and any(r in n for r in READING)]


def test_scores_are_read_once(rows, words):
    got = rows.join(lines.score_lines(rows, words), "line")
    assert read_by_row(got) == []
    assert {(r.line[0], r.score, r.n) for r in got.groupBy("line", "score").agg(F.count("*").alias("n")).collect()} == {(str(i), 1.0, 429 if i < 4 else 428) for i in range(6)}


def test_metric_lines_are_read_once(rows, words):
    got = rows.join(lines.metric_lines(rows, words), "line")
    assert read_by_row(got) == []
    assert {(r.line[0], r.metric, r.n) for r in got.groupBy("line", "metric").agg(F.count("*").alias("n")).collect()} == {(str(i), f"{200 * i} g {MARK} rice, rinsed" if i < 5 else f"1 kg {MARK} rice, rinsed", 429 if i < 4 else 428) for i in range(6)}


def test_ingredients_are_read_once(rows, words):
    got = rows.join(lines.parse_lines(rows, words), "line").select("id", "line", F.posexplode("ingredients").alias("part", "i"))
    assert read_by_row(got) == []
    found = got.groupBy("line", "part", "i.canonical", "i.quantity", "i.unit", "i.note").agg(F.count("*").alias("n")).collect()
    assert {tuple(r)[1:] for r in found} == {(0, f"{MARK} rice", float(i), "cup", "rinsed", 429 if i < 4 else 428) for i in range(6)}


def test_recipes_are_dealt_once(rows, words):
    some = rows.select((F.col("id") % 100).alias("recipe"), (F.col("id") / 100).cast("int").alias("position"), "line")
    got = lines.recipe_ingredients(some, words)
    assert read_by_row(got) == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(recipe" in n for n in plan.split("\n")) == 1
    first = {r.recipe: (r.position, r.canonical, r.raw[0]) for r in got.collect()}
    assert first == {i: (0, f"{MARK} rice", str(i % 7 if i % 7 < 6 else (i + 100) % 7)) for i in range(100)}


def test_lines_are_scaled_once(rows, words):
    got = rows.join(lines.scaled_lines(rows, 2.0), "line", "left")
    assert read_by_row(got) == []
    found = got.groupBy("line", "scaled", "changed").agg(F.count("*").alias("n")).collect()
    right = ["⅛ cup", *(f"{2 * i} cups" for i in range(1, 6))]
    assert {(r.line and r.line[0], r.scaled, r.changed, r.n) for r in found} == {(str(i), f"{x} {MARK} rice, rinsed", True, 429 if i < 4 else 428) for i, x in enumerate(right)} | {(None, None, None, 428)}


def test_the_query_keeps_rows_without_a_line(spark, tmp_path):
    spark.createDataFrame([(1, "red bolt")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    items = [(1, 1, 4, 3.0), (1, 1, 4, 3.0), (2, 1, 1, None)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = plans.QUERIES["scale_lines"](spark, str(tmp_path))
    assert read_by_row(got, "2 x ") == [] and "Aggregate [line" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.l_orderkey, r.line, r.scaled, r.changed) for r in got.collect()) == [(1, "2 x 3 g red bolt", "4 x 3 g red bolt", True)] * 2 + [(2, None, None, False)]
