"""Pages to blocks: headings, paragraphs, list items and images in their order, as columns."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions.measures import let

# Elements whose text is not read, those of them that hold no elements, and elements that begin or end a block.
UNREAD = ("head", "title", "nav", "noscript", "svg")
RAW = ("script", "style")
BREAKS = (
    "h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "div", "td", "th", "tr", "dt", "dd", "blockquote", "section", "article", "header", "footer", "ul",
    "ol", "table", "br", "hr", "figure", "figcaption", "body",
)
_INSIDE = r"""(?:[^>"']|"[^"]*"|'[^']*')*+>"""
_RAW = rf"(?is)<!--.*?-->|<({'|'.join(RAW)})\b{_INSIDE}.*?(?:</\1\s*>|$)"
_UNREAD = rf"(?i)</?(?:{'|'.join(UNREAD)})\b{_INSIDE}"
_MARK = rf"(?i)</?(?:{'|'.join(BREAKS)}|img)\b{_INSIDE}"
_TAG = rf"<[/!?]?[a-zA-Z]{_INSIDE}|</[^a-zA-Z>][^>]*>"
#: Every named character of HTML, by its name with and, for old ones, without the closing sign.
_NAMED = {k: v for k, v in html.entities.html5.items() if k.endswith(";")}
_OLD = {k: v for k, v in html.entities.html5.items() if not k.endswith(";")}
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)"
_OLD_ONE = "^&(" + "|".join(sorted(_OLD, key=len, reverse=True)) + ")"
# What the numbers 128 to 159 stand for, where that is another character.
_WINDOWS = {i: bytes([i]).decode("cp1252") for i in range(128, 160) if i not in (129, 141, 143, 144, 157)}


def _table(known: dict) -> Column:
    return F.from_json(F.lit(json.dumps(known)), "map<string, string>")  # one literal, however many entries


def _numbered(n: Column) -> Column:
    """The character of a number; the sign for a lost one where there is none, nothing for control characters."""
    made = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    control = (n < 32) & ~n.isin(9, 10, 12, 13) | (n == 127)
    lost = n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    return F.when(lost, "\ufffd").when(control, "").otherwise(F.coalesce(_table(_WINDOWS)[n.cast("string")], made))


def unescaped(text: Column) -> Column:
    """Character references read: numbers, names, and old names without their closing sign; what is none stays."""
    def read(hit: Column) -> Column:
        number = F.regexp_extract(hit, "^&#([0-9]+)", 1).try_cast("long")
        hexed = F.conv(F.right(F.regexp_extract(hit, "^&#[xX]0*([0-9a-fA-F]+)", 1), F.lit(9)), 16, 10).try_cast("long")
        old = F.regexp_extract(hit, _OLD_ONE, 1)
        named = F.coalesce(_table(_NAMED)[F.substr(hit, F.lit(2))], F.when(old != "", F.concat(_table(_OLD)[old], F.substr(hit, F.length(old) + 2))))
        return F.when(hit.rlike("^&#[0-9]"), _numbered(number)).when(hit.startswith("&#"), _numbered(hexed)).otherwise(F.coalesce(named, hit))

    def joined(p: Column) -> Column:
        shown = F.concat(F.transform(p["hits"], read), F.array(F.lit("")))
        return F.array_join(F.zip_with(p["gaps"], shown, lambda gap, hit: F.concat(gap, hit)), "")

    parts = F.struct(F.split(text, _REFERENCE).alias("gaps"), F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)).alias("hits"))
    return F.when(text.contains("&"), let(parts, joined)).otherwise(text)


def plain(piece: Column) -> Column:
    """Text without tags, character references read, white space folded."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(piece, _TAG, "")), r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x1c-\x1f\x85]+", " "))


def _readable(page: Column) -> Column:
    """A page without comments and what unread elements hold, however deep they are in each other."""
    def fold(p: Column) -> Column:
        def add(held: Column, m: Column) -> Column:
            step = F.when(m["mark"].startswith("</"), -1).when(m["mark"].endswith("/>"), 0).otherwise(1)
            depth = F.greatest(F.lit(0), held["depth"] + step)
            return F.struct(depth.alias("depth"), F.when(depth == 0, F.concat(held["text"], m["piece"])).otherwise(held["text"]).alias("text"))

        rest = F.zip_with(p["marks"], F.slice(p["pieces"], 2, F.greatest(F.lit(1), F.size(p["pieces"]))), lambda m, x: F.struct(m.alias("mark"), x.alias("piece")))
        return F.aggregate(rest, F.struct(F.lit(0).alias("depth"), p["pieces"][0].alias("text")), add)["text"]

    bare = F.regexp_replace(page, _RAW, "")
    return let(bare, lambda x: let(F.struct(F.split(x, _UNREAD).alias("pieces"), F.regexp_extract_all(x, F.lit(_UNREAD), F.lit(0)).alias("marks")), fold))


def blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, position, tag, kind, text): kind is 'heading', 'image' (text: its source), 'item' or 'text'. A block is what
    stands after the start or end of a block element and before the next. One pass without a shuffle; null pages have no
    blocks."""
    read = pages.select(F.col(id_col).alias("id"), _readable(F.coalesce(html_col, F.lit(""))).alias("x"))
    marks = F.regexp_extract_all("x", F.lit(_MARK), F.lit(0))
    tags = F.concat(F.array(F.lit("")), F.transform(marks, lambda m: F.when(m.startswith("</") | (m.endswith("/>") & ~m.rlike("(?i)^<img")), F.lit("/")).otherwise(F.lower(F.regexp_extract(m, r"<(\w+)", 1)))))
    source = lambda m: F.concat(*(F.regexp_extract(m, r"""(?i)\ssrc\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", i) for i in (1, 2, 3)))
    sources = F.concat(F.array(F.lit("")), F.transform(marks, lambda m: unescaped(source(m))))
    found = F.arrays_zip(tags.alias("tag"), sources.alias("src"), F.split("x", _MARK, -1).alias("piece"))

    def parts(b: Column) -> Column:
        kind = F.when(b["tag"].rlike("^h[1-6]$"), "heading").when(b["tag"] == "li", "item").otherwise("text")
        tag = F.when(b["tag"].isin("img", "/"), "").otherwise(b["tag"])
        piece = F.struct(tag.alias("tag"), kind.alias("kind"), plain(b["piece"]).alias("text"))
        image = F.struct(b["tag"].alias("tag"), F.lit("image").alias("kind"), b["src"].alias("text"))
        return F.when(b["tag"] == "img", F.array(image, piece)).otherwise(F.array(piece))

    solid = F.filter(F.flatten(F.transform(found, parts)), lambda p: p["text"] != "")
    return read.select("id", F.posexplode(solid).alias("position", "p")).select("id", "position", "p.*")
