"""Ingredient lines: what each names and in what amount, and how much a line looks like one, by joins with a vocabulary.

A vocabulary is a table like vocabulary.frame(). Every step works on the distinct lines, so that a line that thousands of
books print is read once, and rows are met again by the line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley import vocabulary as fixed
from galley.functions import measures, prose, scaling
from galley.functions.classify import folded
from galley.functions.measures import let
from galley.operators import names
from galley.operators.recipes import is_title_case

#: Score from which a block is an ingredient line, what a list item needs less, and the most words of one.
THRESHOLD, LIST_BONUS, MOST_WORDS = 0.5, 0.15, 22
_NOTE = "(?is)(?:" + "|".join(sorted(fixed.NOTES, key=len, reverse=True)) + ").*$"
_AND = r"(?i)\s+and\s+|\s*&\s*"
_COUNT_WORD = "(?i)^(?:" + "|".join(measures.WORDS) + r")\b\s*\S"
#: A food and its pages: at most 40 characters without a comma, then numbers.
_PAGES = r"^[^,]{2,40},\s*\d+(?:\s*[-–,]\s*\d+)*$"


def read_once(lines: DataFrame, read: Column) -> DataFrame:
    """The fields of `read`, a struct of what is read from "line", of each distinct line that is not null.

    The lines are dealt over as many tasks as a shuffle has, as reading one costs far more than its bytes tell. The fields
    come out of an array: a filter on one of them, or a join that wants one to be not null, would otherwise be taken over
    to the rows before they are distinct, and every row would be read for it."""
    rows = lines.select("line").where("line is not null").distinct()
    dealt = rows.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "line")
    return dealt.select(F.inline(F.array(read)))


def _sure(vocabulary: DataFrame) -> DataFrame:
    """(canonical, sure, staple): names that the vocabulary knows."""
    known = vocabulary.where("kind in ('noun', 'synonym', 'staple')").select(F.when(F.col("kind") == "synonym", F.col("target")).otherwise(F.col("key")).alias("canonical"), "kind")
    return known.groupBy("canonical").agg(F.bool_or(F.col("kind") != "staple").alias("sure"), F.bool_or(F.col("kind") == "staple").alias("staple"))


def _heads(vocabulary: DataFrame) -> DataFrame:
    """(word): the words that names end with."""
    return vocabulary.where("kind = 'noun'").select(F.substring_index("key", " ", -1).alias("word")).distinct()


def _noted(lines: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(line, quantity, unit, body, note) of the distinct lines: a line's name without what is said of its handling. A note begins with one of
    fixed words; what follows the first comma is one too, unless it holds a word that names end with."""
    def cut(q: Column) -> Column:
        return let(F.struct(q.alias("q"), F.regexp_replace(q["rest"], _NOTE, "").alias("body")), apart_from)

    def apart_from(p: Column) -> Column:
        said = F.btrim(F.substr(p["q"]["rest"], F.length(p["body"]) + 1), F.lit(" ,;"))
        tail = F.when(F.contains(p["body"], F.lit(",")), F.substr(p["body"], F.locate(",", p["body"]) + 1))
        words = F.filter(F.split(folded(F.coalesce(tail, F.lit(""))), "[^a-z0-9_]+"), lambda w: w != "")
        return F.struct("line", p["q"]["quantity"].alias("quantity"), p["q"]["unit"].alias("unit"), p["body"].alias("body"), said.alias("said"), tail.alias("tail"), words.alias("words"))

    rows = read_once(lines, let(measures.parse_quantity(F.trim("line")), cut))
    named = rows.select("line", F.explode("words").alias("word")).join(_heads(vocabulary), "word", "left_semi").select("line", F.lit(True).alias("named")).distinct()
    rows = rows.join(named, "line", "left")
    apart = F.col("named").isNull() & (F.size("words") > 0)
    body = F.when(apart, F.substring_index("body", ",", 1)).otherwise(F.col("body"))
    note = F.concat_ws("; ", F.filter(F.array("said", F.when(apart, F.trim("tail"))), lambda n: n != ""))
    return rows.select("line", "quantity", "unit", F.trim(body).alias("body"), note.alias("note"))


def parse_lines(lines: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(line, ingredients) of the distinct lines that are not null or blank.

    ingredients: array<struct<canonical, display, quantity, unit, note, is_staple>>, in the order of the line. Amount,
    handling note and name are cut apart; a name with 'and' or '&' is several where the vocabulary knows every part. The
    amount goes to the first. A line that names nothing has an empty array."""
    rows = _noted(lines.where(F.trim("line") != ""), vocabulary)
    parts = F.split("body", _AND)
    each = rows.select("line", "quantity", "unit", "note", F.posexplode(F.concat(F.array("body"), F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>")))).alias("at", "phrase"))
    named = names.canonical(each.select("phrase"), vocabulary).join(_sure(vocabulary), "canonical", "left")
    each = each.join(named, "phrase")
    display = F.regexp_replace(F.regexp_replace(F.regexp_replace("phrase", r"\([^)]*\)", " "), r"\s*\[[^\]]*\]", " "), r"\s+", " ")
    display = let(F.btrim(display, F.lit(" ,;:-")), lambda d: F.lower(F.when(d == "", F.col("canonical")).otherwise(d)))
    item = F.struct("at", "canonical", display.alias("display"), F.coalesce("staple", F.lit(False)).alias("is_staple"))
    sure = F.coalesce("sure", F.lit(False)) | (F.col("canonical") == "")
    same = [F.first(c).alias(c) for c in ("quantity", "unit", "note")]
    found = each.groupBy("line").agg(F.array_sort(F.collect_list(item)).alias("items"), F.bool_and(F.when(F.col("at") > 0, sure)).alias("split"), *same)
    wanted = F.filter("items", lambda x: (x["canonical"] != "") & F.when(F.col("split"), x["at"] > 0).otherwise(x["at"] == 0))
    found = found.select("line", wanted.alias("items"), "quantity", "unit", "note")
    first = lambda c, i: F.when(i == 0, F.col(c)).alias(c)
    out = F.transform("items", lambda x, i: F.struct(x["canonical"].alias("canonical"), x["display"].alias("display"), first("quantity", i), first("unit", i), F.col("note").alias("note"), x["is_staple"].alias("is_staple")))
    return found.select("line", out.alias("ingredients"))


def recipe_ingredients(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(recipe, position, canonical, display, raw, quantity, unit, note, is_staple) of rows (recipe, position, line): the
    ingredients of each recipe's lines, each once, at its first mention, numbered from 0. Ties of position go by the line."""
    read = rows.select("recipe", "position", "line").join(parse_lines(rows, vocabulary), "line")
    # Dealt by recipe once, before the lists are taken apart: that serves both windows.
    dealt = read.select("recipe", "position", F.trim("line").alias("raw"), "ingredients").repartition("recipe")
    each = dealt.select("recipe", "position", "raw", F.posexplode("ingredients").alias("part", "i"))
    order = ("position", "raw", "part")
    first = each.withColumn("mention", F.row_number().over(Window.partitionBy("recipe", "i.canonical").orderBy(*order))).where("mention = 1")
    place = F.row_number().over(Window.partitionBy("recipe").orderBy(*order)) - 1
    return first.select("recipe", place.alias("position"), "i.canonical", "i.display", "raw", "i.quantity", "i.unit", "i.note", "i.is_staple")


def leading_amount(text: Column) -> Column:
    """Whether a line opens with a number, or with a word for one and something after it."""
    return let(measures.strip_bullet(measures.plain(text)), lambda t: t.rlike(r"^\s*\d") | F.trim(t).rlike(_COUNT_WORD))


def score_lines(lines: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(line, score) of the distinct lines that are not null: how much a line looks like an ingredient's, from 0 to 1.

    Evidence adds up: an amount in front 0.5, a unit 0.2, a name that the vocabulary knows 0.4 or else a word that names
    end with 0.25, eight words or fewer 0.1; a title's capitals without a digit or unit take 0.6, or without an amount 0.3,
    a verb of cooking in front 0.45, more than 14 words 0.3, a sentence's end after more than 8 words 0.2. Blank lines,
    lines of more than 200 characters, labels inside lists, and entries of an index with their pages are 0."""
    def seen(text: Column) -> Column:
        low = F.btrim(F.lower(text), F.lit(" .:-–—"))
        none = (F.length(text) > 200) | (low == "") | low.startswith("for the") | low.isin(*fixed.SUBHEADS) | text.rlike(_PAGES)
        words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
        read = lambda q: F.struct(q["unit"].alias("unit"), F.coalesce(F.nullif(q["rest"], F.lit("")), text).alias("phrase"), words.alias("words"), leading_amount(text).alias("amount"), is_title_case(text).alias("title"))
        return F.struct("line", text.alias("text"), F.when(~none, let(measures.parse_quantity(text), read)).alias("read"))

    rows = read_once(lines, let(F.trim(measures.plain(F.col("line"))), seen))
    read = rows.where("read is not null").select("line", "text", "read.*")
    sure = names.canonical(read.select("phrase"), vocabulary).join(_sure(vocabulary).where("sure"), "canonical", "left_semi").select("phrase", F.lit(True).alias("sure"))
    ends = names.kept(read.select(F.col("text").alias("phrase")), vocabulary).select(F.col("phrase").alias("text"), F.explode("rest").alias("word"))
    ends = ends.join(_heads(vocabulary), "word", "left_semi").select("text", F.lit(True).alias("ends")).distinct()
    read = read.join(sure, "phrase", "left").join(ends, "text", "left")
    n, unit, amount, title = F.size("words"), F.col("unit").isNotNull(), F.col("amount"), F.col("title")
    when = lambda c, x: F.when(c, x).otherwise(0.0)
    points = (
        when(amount, 0.5) + when(unit, 0.2) + F.when(F.col("sure"), 0.4).when(F.col("ends"), 0.25).otherwise(0.0)
        - F.when(title & ~F.col("text").rlike(r"\d") & ~unit, 0.6).when(title & ~amount, 0.3).otherwise(0.0)
        - when(F.rtrim(F.col("words")[0], F.lit(",.")).isin(*fixed.VERBS), 0.45) - when(n > 14, 0.3)
        - when(F.col("text").rlike("[.!?]$") & (n > 8), 0.2) + when(n <= 8, 0.1)
    )
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), points)), 6)
    return read.select("line", score.alias("score")).unionByName(rows.where("read is null").select("line", F.lit(0.0).alias("score")))


def mark_lines(blocks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """blocks (kind, level, text, ...) with is_line: no image or heading, MOST_WORDS words at most, and a score of THRESHOLD,
    less by LIST_BONUS for list items. A null text is no line."""
    scores = score_lines(blocks.where("kind <> 'image' and level is null").select(F.col("text").alias("line")), vocabulary)
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    least = F.when(F.col("kind") == "item", THRESHOLD - LIST_BONUS).otherwise(THRESHOLD)
    possible = (F.col("kind") != "image") & F.col("level").isNull() & (words <= MOST_WORDS)
    rows = blocks.join(scores.withColumnRenamed("line", "text"), "text", "left")
    return rows.withColumn("is_line", F.coalesce(possible & (F.col("score") >= least), F.lit(False))).drop("score").select(*[c for c in blocks.columns if c != "is_line"], "is_line")


def scaled_lines(lines: DataFrame, factor: float) -> DataFrame:
    """(line, scaled, changed) of the distinct lines that are not null: each times a factor, as scaling.scale_lines has it."""
    return scaling.scale_lines(read_once(lines, F.struct("line")), factor).select("line", "scaled", "changed")


#: Volumes that are weighed where the ingredient's density is known; spoons stay spoons.
_VOLUMES, _SPOONS = ("cup", "fl oz", "pint", "quart", "gallon"), ("tsp", "tbsp")


def _closed(text: Column) -> Column:
    """A text that brackets were taken from, without the gaps they left."""
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r" ([,;:.!?])", "$1")
    return F.btrim(F.regexp_replace(text, r"\(\s*\)|\[\s*\]", ""), F.lit(" ,;:-"))


def metric_lines(lines: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(line, metric) of the distinct lines that are not null: each in metric measures.

    A line in spoons keeps them. Else a metric amount that the book printed in brackets stands for the line's own. Else the
    amount in front is converted: ounces, pounds and sticks to grams, inches to centimetres, a volume to grams where the
    vocabulary knows what a cup of the line's first ingredient weighs ('grams' rows, which liquids have none of), else to
    millilitres. In what is left, and in a line without such an amount, measures inside the text are converted. Only lines
    with a volume in front are looked up in the vocabulary. Metric lines stay as they are, blank ones too."""
    line = F.col("line")
    bare = measures.parse_quantity(F.regexp_replace("line", r"\([^)]*\)|\[[^\]]*\]", " "))["rest"]
    read = F.struct("line", measures.parse_quantity(line).alias("q"), measures.printed_metric(line).alias("printed"), _closed(bare).alias("bare"), prose.convert_text(line).alias("told"))
    rows = read_once(lines, read)
    weighed = rows.where(F.col("q.unit").isin(*_VOLUMES) & F.col("q.quantity").isNotNull() & F.col("printed").isNull())
    grams = vocabulary.where("kind = 'grams'").select(F.col("key").alias("canonical"), F.col("target").try_cast("double").alias("grams"))
    first = parse_lines(weighed.select("line"), vocabulary).select("line", F.try_element_at("ingredients", F.lit(1))["canonical"].alias("canonical"))
    rows = rows.join(first.join(grams, "canonical").select("line", "grams"), "line", "left")
    amount = measures.to_metric(F.col("q.quantity"), F.col("q.unit"), F.col("grams"))
    own = F.when(F.col("bare") == "", F.col("line")).otherwise(F.concat("printed", F.lit(" "), "bare"))
    new = (
        F.when(F.trim("line") == "", F.col("line")).when(F.col("q.unit").isin(*_SPOONS), F.col("told")).when(F.col("printed").isNotNull(), own)
        .otherwise(F.coalesce(F.trim(F.concat(amount, F.lit(" "), "q.rest")), "told"))
    )
    return rows.select("line", new.alias("metric"))
