"""Food nouns as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions.measures import lookup

# Plurals that no ending explains, and words that only look like plurals.
SINGULARS = {
    "leaves": "leaf", "loaves": "loaf", "halves": "half", "knives": "knife", "chillies": "chili", "chilies": "chili",
    "molasses": "molasses", "greens": "greens", "grits": "grits", "brussels": "brussels",
}


def singular(word: Column) -> Column:
    """The word in lower case and in the singular, by its ending. Words of up to three letters stay; null stays null."""
    low = F.lower(word)
    by_ending = (
        F.when((F.length(low) <= 3) | ~low.endswith("s") | low.rlike("(?:ss|us|is)$"), low)
        .when(low.endswith("ies"), F.regexp_replace(low, "ies$", "y"))
        .when(low.rlike("(?:ch|sh|x|z|ss|o)es$"), F.regexp_replace(low, "es$", ""))
        .otherwise(F.regexp_replace(low, "s$", ""))
    )
    return F.coalesce(lookup(low, SINGULARS), by_ending)
