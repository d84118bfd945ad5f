"""Titles as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions.measures import let

# Words that stay in capitals, and words that stay small inside a title.
INITIALISMS = "BBQ BLT PB PBJ NYC LA UK US USA DIY IPA MSG XL TV AM PM OK"
MINOR = "a an the and or but nor of in on at to for from by with over into onto up as per vs via alla au aux de del della en et la le les con e y"


def display_title(title: Column) -> Column:
    """Titles set all in capitals (70 % or more) or all in small letters are recased; others, and those of under four letters,
    stay as they are. Null stays null."""
    letters, capitals = (F.length(F.regexp_replace(title, rf"[^\p{{{kind}}}]", "")) for kind in ("L", "Lu"))

    def cased(w: Column, i: Column, n: Column) -> Column:
        low = F.lower(w)
        lead = F.regexp_extract(low, r"^\P{L}*\p{L}", 0)
        return (
            F.when(F.upper(F.regexp_replace(w, r"\P{L}", "")).isin(INITIALISMS.split()), F.upper(w))
            .when(low.isin(MINOR.split()) & (i > 0) & (i < n - 1), low)
            .otherwise(F.concat(F.upper(lead), F.substr(low, F.length(lead) + 1)))
        )

    words = F.filter(F.split(title, r"(?U)\s+"), lambda w: w != "")
    recased = let(words, lambda ws: F.array_join(F.transform(ws, lambda w, i: cased(w, i, F.size(ws))), " "))
    return F.when((letters < 4) | (capitals > 0) & (10 * capitals < 7 * letters), title).otherwise(recased)
