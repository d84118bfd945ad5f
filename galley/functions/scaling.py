"""Ingredient lines times a factor: a line is cut into amount, unit, brackets and words, and joined again.

Every step is a built-in function over the pieces of one line; no Python runs per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import measures
from galley.functions.measures import let

# Units that measure, after which a bracket restates the amount; lengths, which never scale; packages.
MEASURES = ("tsp", "tbsp", "cup", "oz", "lb", "g", "kg", "ml", "l", "pint", "quart", "gallon", "stick")
LENGTHS = ("inch", "cm")
PACKAGES = ("bag", "box", "bottle", "block", "carton", "container", "envelope", "pouch", "tub")
# Words that agree with their number, beside the packages, and the plurals that no ending tells.
COUNTED = (
    "cup", "teaspoon", "tablespoon", "ounce", "pound", "gram", "kilogram", "liter", "litre", "milliliter", "millilitre", "pint", "quart", "gallon", "stick",
    "clove", "can", "tin", "jar", "package", "packet", "sprig", "slice", "stalk", "head", "piece", "sheet", "fillet", "rasher", "bunch", "pinch", "dash",
    "handful", "egg", "yolk", "white", "onion", "shallot", "lemon", "lime", "orange", "avocado", "potato", "tomato", "carrot", "banana", "apple", "pear",
    "peach", "plum", "date", "fig", "mango", "leaf", "tortilla", "bun", "roll", "breast", "thigh", "drumstick", "steak", "chop", "sausage", "cucumber",
    "courgette", "jalapeño", "jalapeno", "chile", "chili", "chilli", "scallion", "leek", "pepper", "ear", "bagel", "pita", "muffin",
)
PLURALS = {"potato": "potatoes", "tomato": "tomatoes", "mango": "mangoes", "leaf": "leaves", "chili": "chilies", "chilli": "chillies"}
# Number words that may open a line.
NUMBERS = {"one": 1.0, "two": 2.0, "three": 3.0, "four": 4.0, "five": 5.0, "six": 6.0, "seven": 7.0, "eight": 8.0, "nine": 9.0, "ten": 10.0, "eleven": 11.0, "twelve": 12.0}
# Words that may stand before an amount.
HEDGES = ("about", "approximately", "approx.", "approx", "roughly", "around", "scant", "heaping", "heaped", "generous")

_GLYPH = "[" + "".join(measures.FRACTIONS) + "]"
#: One amount: a mixed number with a blank or a hyphen, a number and a fraction of one character, a fraction, a number.
_ONE = rf"(?:\d+[-\s]\s*\d+\s*/\s*\d+|{measures.DECIMAL}\s*{_GLYPH}|\d+\s*/\s*\d+|{_GLYPH}|{measures.DECIMAL})"
_TO = r"\s*(?:-\s*to\b|[-–—]|\bto\b|\bor\b)\s*"
_AMOUNT = rf"({_ONE})(?:({_TO})({_ONE}))?"
_UNIT = measures._UNIT
_LETTER = r"\p{L}"
_BRACKET = r"(?:\([^()]*\)|\[[^\]]*\])"
_LEAD = rf"(?isU)^(\s*(?:{_LETTER}[\w ]{{0,24}}:\s*)?(?:(?:{'|'.join(h.replace('.', '[.]') for h in HEDGES)})\s+)?){_AMOUNT}(.*)$"
#: After a number: what makes it a size, a share, a step's number.
_NO_AMOUNT = rf'(?iU)^(?:-{_LETTER}|[.)](?:\s|$)|\s*(?:inch(?:es)?\b|in\.|"|″|%|°|cm\b))'
_WORD = rf"(?isU)^(\s*)({'|'.join(NUMBERS)})\b(?=\s+\w)(.*)$"
_OF = rf"(?isU)^(.*?\b(?:of|from)\s+)({_ONE})(?=\s+{_LETTER})(.*)$"
_WITH_UNIT = rf"(?isU)^(\s*)({_UNIT})\b\.?(.*)$"
_WITH_METRIC = r"(?isU)^(\s*)(kg|g|ml|l)\b\.?(.*)$"
_PACKED = rf"(?isU)^(\s*{_BRACKET}\s*)((?:{_UNIT}|(?:{'|'.join(PACKAGES)})(?:es|s)?)\b)(.*)$"
_SIZED = rf"(?sU)^(\s*{_BRACKET})(.*)$"
#: An amount that restates the line's own: with a unit, or before a word.
_RESTATED = rf"(?iU)(?<![\w/.,]){_AMOUNT}(?:(\s*-?\s*)({_UNIT})\b|(?=\s+{_LETTER}))"
_RESTATED_PARTS = rf"(?iU)^{_AMOUNT}(?:(\s*-?\s*)({_UNIT}))?$"


def plural(word: str) -> str:
    """By the word's ending, or as listed."""
    return PLURALS.get(word) or word + ("es" if word.endswith(("ch", "sh", "x")) else "s")


_MANY = {w: plural(w) for w in COUNTED + PACKAGES}
_SINGLE = {many: one for one, many in _MANY.items()}


def parts(text: Column, pattern: str, n: int) -> Column:
    """The first n groups of a pattern as an array of texts, '' where one took no part."""
    return F.array(*(F.regexp_extract(text, pattern, i + 1) for i in range(n)))


def rewritten(text: Column, pattern: str, body: Callable[[Column, Column, Column], Column]) -> Column:
    """text with each match replaced by body(match, what follows it up to the next match, its number)."""
    pieces = F.struct(F.split(text, pattern).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def joined(p: Column) -> Column:
        new = F.transform(p["found"], lambda m, i: body(m, F.get(p["gaps"], i + 1), i))
        return F.array_join(F.zip_with(p["gaps"], F.concat(new, F.array(F.lit(""))), lambda gap, m: F.concat(gap, m)), "")

    return let(pieces, joined)


def value(amount: Column) -> Column:
    """An amount as a double; null if it is none, as 1/0."""
    return measures.number(measures.plain(F.regexp_replace(amount, "-", " ")))


def scaled(first: Column, second: Column, factor: Column) -> Column:
    """The amounts of a range, or one, times the factor, without those that are none."""
    return F.filter(F.transform(F.filter(F.array(first, second), lambda a: a != ""), lambda a: value(a) * factor), lambda v: v.isNotNull())


def agree(word: Column, amount: Column) -> Column:
    """The word in the number that goes with the amount, in its own case; one that is not counted stays."""
    low = F.lower(word)
    other = F.when(amount > 1, measures.lookup(low, _MANY)).otherwise(measures.lookup(low, _SINGLE))
    first = F.substring(word, 1, 1)
    cased = lambda o: F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(o)).when(F.upper(first) == first, F.concat(F.upper(F.substring(o, 1, 1)), F.substr(o, F.lit(2)))).otherwise(o)
    return F.coalesce(let(other, cased), word)


def agree_noun(rest: Column, amount: Column) -> Column:
    """rest with the counted thing made to agree: the last word before the first comma, bracket, 'or' or 'and'."""
    end = r"[,;(\[]|\b(?:or|and)\b"
    pattern = rf"(?isU)^((?:(?!{end}).)*?)({_LETTER}+(?:-{_LETTER}+)*)((?:(?!{end})\P{{L}})*)((?:{end}).*)?$"
    return let(parts(rest, pattern, 4), lambda g: F.when(g[1] == "", rest).otherwise(F.concat(g[0], agree(g[1], amount), g[2], g[3])))


def nice(values: Column, to: Column) -> Column:
    """One or two amounts as a recipe writes them, with the sign between."""
    return F.when(F.size(values) > 1, F.concat(measures.nice_number(values[0]), to, measures.nice_number(values[1]))).otherwise(measures.nice_number(values[0]))


def metric(values: Column, to: Column, unit: Column) -> Column:
    """One or two metric amounts, rounded as a cook measures, with one unit: from 1000 on kilos or litres, to 50."""
    low = F.lower(unit)
    weight = low.isin("g", "kg")
    steps = F.transform(values, lambda v: let(v * F.when(low.isin("kg", "l"), 1000).otherwise(1), lambda x: F.greatest(F.lit(1), F.when(weight, measures.round_g(x)).otherwise(measures.round_ml(x)))))

    def written(r: Column) -> Column:
        large = F.array_max(r) >= 1000
        one = lambda x: F.when(large, measures.short(F.bround(x / 50) * 50 / 1000, 2)).otherwise(x.cast("string"))
        sign = F.when(large, F.when(weight, "kg").otherwise("l")).otherwise(F.when(weight, "g").otherwise("ml"))
        return F.concat(F.when(F.size(r) > 1, F.concat(one(r[0]), to, one(r[1]))).otherwise(one(r[0])), F.lit(" "), sign)

    return let(steps, written)


def canonical_unit(word: Column) -> Column:
    return F.coalesce(measures.lookup(F.lower(word), measures._SPELLING), F.lit(""))


def restated(match: Column, after: Column, factor: Column, counted: Column) -> Column:
    """One amount of a bracket or after a slash. Lengths stay, and so does a hyphenated size of counted things or before a
    word, which names a thing: 13.5-ounce can."""
    def new(g: Column) -> Column:
        size = g[3].contains("-") & (counted | after.rlike(rf"(?U)^\s*{_LETTER}"))
        stays = (g[4] != "") & (canonical_unit(g[4]).isin(*LENGTHS) | size)

        def with_values(v: Column) -> Column:
            plain = nice(v, g[1])
            return (
                F.when(stays | (F.size(v) == 0), match).when(g[4] == "", plain).when(F.lower(g[4]).isin("g", "kg", "ml", "l"), metric(v, g[1], g[4]))
                .otherwise(F.concat(plain, g[3], agree(g[4], F.array_max(v))))
            )

        return let(scaled(g[0], g[2], factor), with_values)

    return let(parts(match, _RESTATED_PARTS, 5), new)


def _bracketed(text: Column, factor: Column, counted: Column) -> Column:
    """text with the amounts of its brackets scaled."""
    return rewritten(text, _BRACKET, lambda bracket, after, i: rewritten(bracket, _RESTATED, lambda m, then, j: restated(m, then, factor, counted)))


def _slashed(text: Column, factor: Column, counted: Column) -> Column:
    """text with its first amount scaled."""
    return rewritten(text, _RESTATED, lambda m, after, i: F.when(i == 0, restated(m, after, factor, counted)).otherwise(m))


def scale_lines(rows: DataFrame, factor: Column | float, line_col: str = "line") -> DataFrame:
    """rows with (scaled, changed): each ingredient line times a factor of more than 0.

    The amount in front is scaled, after a label or a hedge; else a number word in front; else the number after 'of' or
    'from'; else amounts in brackets. After a measured amount a bracket says the same again and is scaled too; after a count
    it is the size of each piece and stays, while later ones are scaled. '2 x 400 g' stays 400 g. Metric amounts are rounded
    as they are measured, others written with fractions; counted words agree with their number. What cannot be read stays
    as it is, and so does any line at a factor of 1 or null; a null line stays null and unchanged. Rows are read one by one:
    there is no shuffle. Columns named like _PARTS are replaced."""
    by = (F.lit(float(factor)) if isinstance(factor, (int, float)) else factor).cast("double")
    x = F.col(f"`{line_col}`")
    out = rows.withColumns({"_by": by, "_lead": parts(x, _LEAD, 5), "_word": parts(x, _WORD, 3), "_of": parts(x, _OF, 3)})
    c, none = F.col, F.array().cast("array<double>")
    one = lambda v: F.when(v.isNotNull() & (v != 0), F.array(v)).otherwise(none)
    out = out.withColumns({
        "_v": F.when((c("_lead")[1] != "") & ~c("_lead")[4].rlike(_NO_AMOUNT), scaled(c("_lead")[1], c("_lead")[3], c("_by"))).otherwise(none),
        "_w": F.when(c("_word")[1] != "", F.array(measures.lookup(F.lower(c("_word")[1]), NUMBERS) * c("_by"))).otherwise(none),
        "_o": one(value(c("_of")[1]) * c("_by")),
    })
    mode = F.when(x.isNull() | c("_by").isNull() | (c("_by") == 1), "same").when(F.size("_v") > 0, "lead").when(F.size("_w") > 0, "word").when(F.size("_o") > 0, "of").otherwise("none")
    out = out.withColumn("_mode", mode)
    pick = lambda lead, word, of, other: F.when(c("_mode") == "lead", lead).when(c("_mode") == "word", word).when(c("_mode") == "of", of).otherwise(other)
    out = out.withColumns({
        "_pre": pick(c("_lead")[0], c("_word")[0], c("_of")[0], F.lit("")), "_rest": pick(c("_lead")[4], c("_word")[2], c("_of")[2], x),
        "_v": pick(c("_v"), c("_w"), c("_o"), none), "_to": c("_lead")[2],
    })
    out = out.withColumns({"_unit": parts(c("_rest"), _WITH_UNIT, 3), "_metric": parts(c("_rest"), _WITH_METRIC, 3), "_packed": parts(c("_rest"), _PACKED, 3), "_sized": parts(c("_rest"), _SIZED, 2)})
    lead = c("_mode") == "lead"
    kind = (
        F.when(c("_mode").isin("same", "none"), c("_mode")).when(lead & c("_rest").rlike(r"(?i)^\s*[x×]\s*"), "packs").when(lead & (c("_metric")[1] != ""), "metric")
        .when((c("_mode") != "of") & (c("_unit")[1] != ""), "unit").when(lead & (c("_packed")[1] != ""), "packed").otherwise("bare")
    )
    out = out.withColumns({"_kind": kind, "_most": F.array_max("_v")}).withColumn("_amount", F.when(c("_kind") == "metric", metric(c("_v"), c("_to"), c("_metric")[1])).when(F.size("_v") > 0, nice(c("_v"), c("_to"))).otherwise(""))
    group = lambda g: F.concat(c(g)[0], agree(c(g)[1], c("_most")))
    sized = lead & (c("_sized")[0] != "")
    out = out.withColumns({
        "_head": F.when(c("_kind") == "unit", group("_unit")).when(c("_kind") == "packed", group("_packed")).when((c("_kind") == "bare") & sized, c("_sized")[0]).otherwise(""),
        "_tail": F.when(c("_kind") == "unit", c("_unit")[2]).when(c("_kind") == "packed", c("_packed")[2]).when(c("_kind") == "metric", c("_metric")[2])
        .when(c("_kind") == "bare", agree_noun(F.when(sized, c("_sized")[1]).otherwise(c("_rest")), c("_most"))).otherwise(c("_rest")),
        "_counted": c("_kind").isin("packed", "bare") | (c("_kind") == "unit") & ~canonical_unit(c("_unit")[1]).isin(*MEASURES),
        "_again": (c("_kind") == "none") | lead & (c("_kind") != "packs"),
    })
    out = out.withColumn("_slash", parts(c("_tail"), r"(?s)^(\s*/\s*[^,;()]*)(.*)$", 2))
    out = out.withColumn("_tail", F.when(c("_again") & (c("_slash")[0] != ""), F.concat(_slashed(c("_slash")[0], c("_by"), c("_counted")), c("_slash")[1])).otherwise(c("_tail")))
    out = out.withColumn("_tail", F.when(c("_again"), _bracketed(c("_tail"), c("_by"), c("_counted"))).otherwise(c("_tail")))
    new = F.when(c("_kind") == "same", x).otherwise(F.concat("_pre", "_amount", "_head", "_tail"))
    changed = F.when(c("_kind") == "none", c("_tail") != x).otherwise(c("_kind") != "same")
    return out.withColumns({"scaled": new, "changed": F.coalesce(changed, F.lit(False))}).drop(*_PARTS)


_PARTS = ("_by", "_lead", "_word", "_of", "_v", "_w", "_o", "_mode", "_pre", "_rest", "_to", "_unit", "_metric", "_packed", "_sized", "_kind", "_most", "_amount", "_head", "_tail", "_counted", "_again", "_slash")
