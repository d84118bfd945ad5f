"""Recipes out of a book's blocks: runs of ingredient lines, the title above each, the method below it.

Blocks are rows (book, position, kind, level, bold, text, is_line); is_line marks ingredient lines (lines.mark_lines), level is
that of a heading, else null. Each step is a join on (book, run) or a window within one book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.functions.measures import let
from galley.vocabulary import VERBS

#: Fewest lines of a run, most blocks without a line inside one, blocks above a run that may name it, most blocks of a method,
#: blocks above a title that may hold its section.
LEAST, GAP, ABOVE, METHOD, SECTION = 3, 2, 14, 80, 400
# Headings that label a part of a recipe or of a book.
PARTS = ("ingredients", "method", "directions", "instructions", "preparation", "introduction", "contents", "index", "acknowledgements", "copyright")
METHODS = ("method", "directions", "instructions", "preparation")
# Words that a title may write small.
SMALL = ("a", "an", "the", "and", "or", "of", "with", "in", "on", "for", "to", "from", "at", "by", "de", "la", "le", "el", "con", "alla", "all")
# Words before the numbers of a recipe.
LABELS = ("serves", "servings", "makes", "yield", "feeds", "prep", "preparation", "cook", "cooking", "total", "ready in", "hands-on", "hands on", "active", "bake", "baking", "chill", "rest")
_NUMBERS = rf"(?i)\b(?:{'|'.join(LABELS)})\b[^a-z]{{0,4}}(?:\d|time)"
# Words that open a line saying how much a recipe makes, and what it may count.
YIELDS = ("makes", "serves", "serving", "servings", "yield", "yields", "feeds")
SERVED = (
    "serving", "servings", "portion", "portions", "people", "burger", "burgers", "cookie", "cookies", "piece", "pieces", "slice", "slices", "bar", "bars", "muffin", "muffins",
    "cupcake", "cupcakes", "quesadilla", "quesadillas", "pizza", "pizzas", "loaves", "loaf", "jar", "jars", "cake", "cakes", "sandwiches", "taco", "tacos", "roll", "rolls",
    "scone", "scones", "pancake", "pancakes", "waffle", "waffles", "dozen",
)


def heading_key(text: Column) -> Column:
    """A heading without the signs and blanks around it, in lower case."""
    return F.lower(F.regexp_replace(text, r"^[\s.:–—-]+|[\s.:–—-]+$", ""))


def is_part(text: Column) -> Column:
    """Whether a heading labels a part instead of naming a dish."""
    return let(heading_key(text), lambda k: k.isin(*PARTS) | k.startswith("for the") | (F.length(k) < 2))


def is_title_case(text: Column) -> Column:
    """Two or more words beside small ones, of which three in four (two at least) begin with a capital."""
    words = F.filter(F.split(F.trim(text), r"[\s/]+"), lambda w: (w != "") & ~F.lower(F.regexp_replace(w, r"^[,.]+|[,.]+$", "")).isin(*SMALL))
    capital = lambda w: F.substring(w, 1, 1).rlike(r"^\p{Lu}")
    count = lambda ws: F.size(F.filter(ws, capital)) >= F.greatest(F.lit(2), F.floor(F.size(ws) * 0.75))
    return let(words, lambda ws: (F.size(ws) >= 2) & count(ws))


def servings(header: Column, title: Column) -> Column:
    """How much a recipe makes: after a word that says so, in the header or else the title, a number or a range and what is
    counted, if that is a known thing; '' where nothing says it."""
    number = rf"(?i)\b(?:{'|'.join(y for y in YIELDS)})\b[:\s]*(\d+(?:\s*(?:to|or|[-–])\s*\d+)?(?:\s+(?:{'|'.join(sorted(SERVED, key=len, reverse=True))}))?)"
    found = lambda c: F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), number, 1))
    return F.coalesce(F.nullif(found(header), F.lit("")), found(title))


def confidence(heading: Column, title: Column, lines: Column, method: Column, time_source: Column, serves: Column, core: Column) -> Column:
    """How far a recipe's reading can be trusted, from 0 to 1: a quarter to begin with, as much for a heading as title, 0.1 for
    any title, 0.15 each for five lines or more, a method of 25 words or more and a time that a label states (0.05 for one of the
    method), 0.05 for servings; less 0.3 where no line of the method opens with a verb of cooking, and a quarter for fewer than
    two ingredients beside staples. Nulls count as missing."""
    text = F.coalesce(method, F.lit(""))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    opens = lambda x: F.rtrim(F.lower(F.regexp_extract(x, r"^\s*(\S+)", 1)), F.lit(",.")).isin(*VERBS)
    when = lambda c, x: F.when(F.coalesce(c, F.lit(False)), x).otherwise(0.0)
    points = (
        F.lit(0.25) + when(heading, 0.25) + when(title != "", 0.1) + when(lines >= 5, 0.15) + when(words >= 25, 0.15) - when(~F.exists(F.split(text, "\n"), opens), 0.3)
        + when(time_source.isin("label", "labels-summed"), 0.15) + when(time_source == "method", 0.05) + when(serves != "", 0.05) - when(F.coalesce(core, F.lit(0)) < 2, 0.25)
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), points)), 6)


def fitness(kind: Column, level: Column, bold: Column, text: Column) -> Column:
    """How well a block names a recipe, null if it cannot: a heading, best of level 2 or 3, in title case, in bold. A line that
    says how much a recipe makes names none, nor does one that opens with a verb of cooking, unless it is a heading."""
    words = F.size(F.split(F.trim(text), r"\s+"))
    prose = F.trim(text).rlike(r"[.!?]$") & (words > 4)
    yields = F.trim(text).rlike(rf"(?i)^(?:{'|'.join(YIELDS)})\b")
    order = level.isNull() & F.lower(F.regexp_extract(F.trim(text), r"^(\S+?)[,.]*(?:\s|$)", 1)).isin(*VERBS)
    possible = (kind != "image") & F.length(F.trim(text)).between(2, 120) & (words <= 14) & ~prose & ~is_part(text) & ~text.rlike(_NUMBERS) & ~yields & ~order
    points = F.lit(1.0) + F.when(level.isNotNull(), 2.0).otherwise(0.0) + F.when(level.isin(2, 3), 1.0).otherwise(0.0)
    return F.when(possible, points + F.when(is_title_case(text), 2.0).otherwise(0.0) + F.when(bold, 0.5).otherwise(0.0))


def runs(blocks: DataFrame) -> DataFrame:
    """(book, run, first, last, lines): runs of lines with at most GAP other blocks between two, LEAST lines or more. Runs of
    a book are numbered from 1 by place."""
    w = Window.partitionBy("book").orderBy("position")
    hits = blocks.where("is_line").select("book", "position")
    new = F.when(F.col("position") - F.lag("position").over(w) <= GAP + 1, 0).otherwise(1)
    found = hits.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy("book", "run")
    found = found.agg(F.min("position").alias("first"), F.max("position").alias("last"), F.count("*").alias("lines")).where(F.col("lines") >= LEAST)
    return found.withColumn("run", F.row_number().over(Window.partitionBy("book").orderBy("first")))


def _around(found: DataFrame, blocks: DataFrame, low: Column, high: Column) -> DataFrame:
    """Runs with every block from low to high of their book. Places are dealt in spans of METHOD blocks, so the join is by
    equal keys and a block meets only the runs near it."""
    spans = F.explode(F.sequence(F.floor(low / METHOD), F.floor(high / METHOD)))
    near = found.withColumns({"low": low, "high": high}).where("low <= high").withColumn("span", spans)
    return near.join(blocks.withColumn("span", F.floor(F.col("position") / METHOD)), ["book", "span"]).where("position between low and high").drop("span")


def recipes(blocks: DataFrame) -> DataFrame:
    """(book, run, title_at, title, first, last, lines, method, image, section): a recipe for each run.

    The title is the best of the ABOVE blocks over the run that follow the run before, nearer ones first by a fifth of a
    point a block; '' if none fits. The method is the text from the run's end to the next recipe's title, METHOD blocks at
    most, up to a heading of level 1 or 2 after its first text; the headings of methods are left out. The image is the
    nearest to the title between the run before and that end. The section is the last heading of level 1 among the SECTION
    blocks before the title.
    Null texts are empty, empty tables give no rows."""
    rows = blocks.withColumn("text", F.trim(F.coalesce("text", F.lit(""))))
    order = Window.partitionBy("book").orderBy("run")
    found = runs(rows).withColumn("floor", F.coalesce(F.lag("last").over(order) + 1, F.lit(0)))
    above = _around(found, rows, F.greatest(F.col("floor"), F.col("first") - ABOVE), F.col("first") - 1).where("not is_line")
    above = above.withColumn("fit", fitness(F.col("kind"), F.col("level"), F.col("bold"), F.col("text")) - 0.2 * (F.col("first") - 1 - F.col("position")))
    best = above.where("fit > 0").groupBy("book", "run").agg(F.max_by(F.struct("position", "text"), F.struct("fit", "position")).alias("t"))
    named = found.join(best, ["book", "run"], "left")
    named = named.select("book", "run", "first", "last", "lines", "floor", F.coalesce("t.position", "first").alias("title_at"), F.coalesce("t.text", F.lit("")).alias("title"))
    ends = rows.groupBy("book").agg((F.max("position") + 1).alias("end"))
    named = named.join(ends, "book").withColumn("stop", F.coalesce(F.lead("title_at").over(order), F.col("end")))

    below = _around(named, rows, F.col("last") + 1, F.least(F.col("stop"), F.col("last") + 1 + METHOD) - 1)
    label = F.col("level").isNotNull() & heading_key(F.col("text")).isin(*METHODS)
    below = below.where((F.col("text") != "") & ~label)
    texts = below.groupBy("book", "run").agg(F.array_sort(F.collect_list(F.struct("position", F.coalesce("level", F.lit(9)).alias("level"), "text"))).alias("b"))
    cut = F.filter("b", lambda x, i: (x["level"] <= 2) & (i > 0))
    kept = F.filter("b", lambda x: (F.size("cut") == 0) | (x["position"] < F.col("cut")[0]["position"]))
    texts = texts.withColumn("cut", cut).select("book", "run", F.array_join(F.transform(kept, lambda x: x["text"]), "\n").alias("method"))

    pictures = rows.where("kind = 'image'")
    seen = _around(named, pictures, F.col("floor"), F.col("stop") - 1)
    near = F.struct(F.abs(F.col("position") - F.col("title_at")), "position")
    images = seen.groupBy("book", "run").agg(F.min_by("text", near).alias("image"))

    chapter = rows.where((F.col("level") == 1) & ~is_part(F.col("text"))).select("book", F.col("position").alias("at"), F.lit(0).alias("run"), F.struct("position", "text").alias("chapter"))
    marks = named.select("book", F.col("title_at").alias("at"), "run", F.lit(None).cast("struct<position: int, text: string>").alias("chapter"))
    upto = Window.partitionBy("book").orderBy("at", F.desc("run")).rowsBetween(Window.unboundedPreceding, 0)
    sections = chapter.unionByName(marks).withColumn("section", F.last("chapter", True).over(upto)).where("run > 0")
    sections = sections.select("book", "run", F.when(F.col("section.position") > F.col("at") - SECTION, F.col("section.text")).alias("section"))
    whole = named.join(texts, ["book", "run"], "left").join(images, ["book", "run"], "left").join(sections, ["book", "run"], "left")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return whole.select("book", "run", "title_at", "title", "first", "last", "lines", blank("method"), blank("image"), blank("section"))
