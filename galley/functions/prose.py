"""Imperial measures in running text to metric, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions import measures

# Imperial words of running text, the metric unit each is turned into, and how much of it one is.
MEASURES = {
    "inch": ("cm", 2.54), "inches": ("cm", 2.54), "in.": ("cm", 2.54), '"': ("cm", 2.54), "pound": ("g", 453.592), "pounds": ("g", 453.592),
    "lb": ("g", 453.592), "lbs": ("g", 453.592), "ounce": ("g", 28.3495), "ounces": ("g", 28.3495), "oz": ("g", 28.3495), "cup": ("ml", 240.0),
    "cups": ("ml", 240.0),
}
_SIZE = r"(?:(?:\d+\s+)?\d+\s*/\s*\d+|\d+(?:\.\d+)?)"
_WORD = "|".join(w + r"\b" if w.isalpha() else w.replace(".", r"\.(?!\w)") for w in sorted(MEASURES, key=len, reverse=True))


#: A number of two or three digits with what may make it a temperature: a degree sign or word, and a word with F or C.
_READING = r"(?i)(?<!\d)\d{2,3}(?!\d)(?:\s*(?:°|degrees?))?(?:\s*[fc]\w*)?"
# Names of the two scales.
SCALES = {"f": "F", "fahrenheit": "F", "c": "C", "celsius": "C"}
#: An amount and a word.
AMOUNT = rf"(?i){_SIZE}[\s-]*(?:{_WORD})"


def replace_each(text: Column, pattern: str, body: Callable[[Column], Column]) -> Column:
    """Each match of the pattern replaced by body(match), or kept where that is null (1/0, numbers too large for a long). The pattern must not match empty text."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.array_join(F.zip_with(gaps, F.transform(hits, lambda hit: F.coalesce(body(hit), hit)), lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit("")))), "")


def celsius(fahrenheit: Column) -> Column:
    """Degrees Celsius to the nearest 5, halves to even."""
    return (F.bround((fahrenheit - 32) * 5 / 9 / 5, 0) * 5).cast("int")


def centimetres(inches: Column) -> Column:
    """Centimetres as text: under 5 to halves, else whole, halves to even."""
    cm = inches * 2.54
    return F.when(cm < 5, measures.short(F.bround(cm * 2, 0) / 2, 1)).otherwise(F.bround(cm, 0).try_cast("long").cast("string"))


def _reading(token: Column) -> Column:
    """struct(text, number, scale) of a token: F, with a degree sign or word or without; C with one; '' for a bare number;
    else null."""
    said = F.lower(F.trim(F.regexp_replace(token, r"^\d+", "")))
    name = F.regexp_replace(said, r"^(?:°|degrees?)\s*", "")
    scale = measures.lookup(name, SCALES)
    known = F.when(said == "", "").when((name == said) & ((scale == "C") | (name == "fahrenheit")), None).otherwise(scale)
    return F.struct(token.alias("text"), F.regexp_extract(token, r"^\d+", 0).cast("int").alias("number"), known.alias("scale"))


def degrees(text: Column) -> Column:
    """text with its degrees Fahrenheit in Celsius. Where Celsius stands in brackets behind, it takes the place of the number
    before it and the brackets go."""
    def read(p: Column) -> Column:
        at = lambda i: F.get(p["hits"], i)
        gap = lambda i: F.trim(F.coalesce(F.get(p["gaps"], i), F.lit("")))
        twice = lambda h, i: at(i)["scale"].isin("", "F") & gap(i + 1).isin("(", "[") & (at(i + 1)["scale"] == "C") & F.substring(gap(i + 2), 1, 1).isin(")", "]")
        return F.struct(p["gaps"].alias("gaps"), p["hits"].alias("hits"), F.transform(p["hits"], lambda h, i: F.coalesce(twice(h, i), F.lit(False))).alias("twice"))

    def joined(p: Column) -> Column:
        double = lambda i: F.coalesce(F.when(i >= 0, F.get(p["twice"], i)), F.lit(False))
        shown = lambda n: F.concat(n.cast("string"), F.lit("°C"))

        def piece(g: Column, i: Column) -> Column:
            h = F.get(p["hits"], i)
            before = F.when(double(i - 1), "").when(double(i - 2), F.regexp_replace(g, r"^\s*[)\]]", "")).otherwise(g)
            own = F.when(double(i), "").when(double(i - 1), shown(h["number"])).when(h["scale"] == "F", shown(celsius(h["number"]))).otherwise(h["text"])
            return F.concat(before, F.coalesce(own, F.lit("")))

        return F.array_join(F.transform(p["gaps"], piece), "")

    parts = F.struct(F.split(text, _READING).alias("gaps"), F.transform(F.regexp_extract_all(text, F.lit(_READING), F.lit(0)), _reading).alias("hits"))
    return F.when(text.rlike(r"(?i)\d\s*(?:°|degrees?)?\s*[fc]"), measures.let(measures.let(parts, read), joined)).otherwise(text)


def convert_text(text: Column) -> Column:
    """Prose with °F, inches, pounds, ounces and cups in metric. The text's own °C beside °F wins. A text without such
    measures stays as it is, fractions of one character included; null stays null."""
    size = lambda hit: measures.number(F.regexp_replace(F.regexp_extract(hit, _SIZE, 0), r"\s*/\s*", "/"))
    unit = lambda hit: F.lower(F.regexp_extract(hit, f"(?i)({_WORD})$", 1))

    def metric(hit: Column) -> Column:
        much = size(hit) * measures.lookup(unit(hit), {w: factor for w, (_, factor) in MEASURES.items()})
        kind = measures.lookup(unit(hit), {w: to for w, (to, _) in MEASURES.items()})
        return (
            F.when(kind == "cm", F.concat(centimetres(much / 2.54), F.lit(" cm"))).when(kind == "g", measures.amount(measures.round_g(much), "g"))
            .otherwise(measures.amount(measures.round_ml(much), "ml"))
        )

    return measures.let(measures.plain(text), lambda x: measures.let(replace_each(degrees(x), AMOUNT, metric), lambda new: F.when(new == x, text).otherwise(new)))
