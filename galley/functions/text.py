"""Column functions on short texts and bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(c: Column) -> Column:
    """Blanks run together, none beside newlines, at most one empty line between paragraphs."""
    c = F.regexp_replace(c, "[ \\t\\f\\x0B\\u00A0]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, " ?\\n ?", "\n"), "\\n{3,}", "\n\n"))


def clean_metadata(c: Column) -> Column:
    """Without separators and blanks at either end."""
    return F.regexp_replace(F.regexp_replace(c, "^[ ;,·|/&]+", ""), "[ ;,·|/&]+$", "")


def cache_name(book: Column, ref: Column, thumb: bool = False) -> Column:
    """File name of a cached picture: 20 hex digits of the SHA-256 of its parts."""
    parts = [book, ref] + ([F.lit("thumb")] if thumb else [])
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20)


def content_type(data: Column) -> Column:
    """Kind of picture by its first bytes."""
    head = F.hex(F.substring(data, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("47494638"), "image/gif").when(head.startswith("52494646") & head.endswith("57454250"), "image/webp")
        .otherwise("application/octet-stream")
    )


def heading_like(line: Column) -> Column:
    """A plain line that looks like a heading: 1 to 12 words, no closing . , ; or :, all upper case or at least 60 % capitalised."""
    words = F.filter(F.split(F.trim(line), "\\s+"), lambda w: w != "")
    n = F.size(words)
    capital = F.size(F.filter(words, lambda w: w.rlike("^\\p{Lu}")))
    upper = (F.upper(line) == line) & line.rlike("\\p{L}")
    return (n > 0) & (n <= 12) & ~F.trim(line).rlike("[.,;:]$") & (upper | (capital >= 0.6 * n))
