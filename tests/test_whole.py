"""Registered queries on recipe lines over whole tables, row by row against plain Python."""

import re
import unicodedata
from collections import Counter

import pytest

import __spark_entry__
from galley import catalog
from galley.functions import classify, measures, nouns, titles

ODD = [
    None, "", "\n", "2 tbsp olive oil\n\n- 1½ cups flour (180 g)\n2 x 400g cans", "99999999999999999999 hours and 9999999999999 minutes", "Total 99999999999 hours", "1/0 cup, 0/0 lb of 1/0 inch",
    "9" * 400 + " lbs", "(99999999999999999999 g) [1.50 kg]", "a\r\nMOM'S PIE AND CREAM\nbbq chicken of the day", "Bake at 350°F in a 9-inch tin, 2 lbs, 3 cups; 400°F (200°C)", "180 degrees celsius, 75 [24 ° C ] or 250 F, 1350°F and 99°Fa; 212 f (100 c)", "MemoryError: x", "no such FILE", "Leaves potatoes\tberries buses",
    "serves 4 to 6", "word " * 20000, "1 " * 3000, "bake 10 minutes. " * 200, "É" * 50 + " le pâté",
]


def half_up(x, step):
    return round(x / step) * step


def short(x, places):
    return f"{x:.{places}f}".rstrip("0").rstrip(".")


def plain(t):
    for a, b in measures.FRACTIONS.items():
        t = t.replace(a, " " + b)
    return t.replace("⁄", "/").replace(" ", " ")


def number(t):
    m = re.fullmatch(rf"({measures.DECIMAL})?\s*(?:(\d+)\s*/\s*(\d+))?", t.strip(" "), re.A)
    if not m or not (m[1] or m[2]):
        return None
    part = int(m[2]) / int(m[3]) if m[3] and int(m[3]) else None
    whole = float(m[1].replace(",", ".")) if m[1] else None
    return whole + part if None not in (whole, part) else whole if whole is not None else part


def nice(v):
    if v >= 20:
        return str(round(v)) if v < 2**63 else None
    if v >= 10:
        return f"{int(round(v * 2) / 2)}" + ("½" if round(v * 2) % 2 else "")
    glyph = min(measures.WRITTEN, key=lambda w: abs(w[0] - v % 1))[1]
    n = int(v) + (glyph == "+")
    return f"{n or ''}{glyph.strip('+')}" or "⅛"


def servings(x):
    first = re.search(r"\d+", x or "", re.A)
    base = int(first[0]) if first else 0
    return base if 0 < base < 2**31 else None, re.sub(measures._ATOM, lambda m: nice((number(m[0]) or 0) * 2) or m[0], plain(x or ""), flags=re.A)


def printed(x):
    found = None
    for b in re.findall(r"\([^()]*(?:\[[^\]]*\])?[^()]*\)|\[[^\]]*\]", plain(x or "")):
        hits = re.findall(r"(?i)(\d+(?:[.,]\d+)?)\s*[-–]?\s*(kg|g|ml|l|cm)\b", b)
        if hits and float(hits[-1][0].replace(",", ".")) > 0:
            v = float(hits[-1][0].replace(",", "."))
            found = f"{short(v, 2) if v < 1e15 else int(v)} {hits[-1][1].lower()}"
    return (found,)


def shown(t):
    letters = [c for c in t or "" if c.isalpha()]
    capitals = sum(unicodedata.category(c) == "Lu" for c in letters)
    if t is None or len(letters) < 4 or capitals and 10 * capitals < 7 * len(letters):
        return (t,)
    words, out = t.split(), []
    for i, w in enumerate(words):
        low, at = w.lower(), next((k for k, c in enumerate(w) if c.isalpha()), -1) + 1
        if "".join(c for c in w if c.isalpha()).upper() in titles.INITIALISMS.split():
            out.append(w.upper())
        else:
            out.append(low if low in titles.MINOR.split() and 0 < i < len(words) - 1 else low[:at].upper() + low[at:])
    return (" ".join(out),)


INCH, POUND, OUNCE, CUP = 2.54, 453.592, 28.3495, 240.0
WORDS = {"inches": INCH, "inch": INCH, "in.": INCH, '"': INCH, "pounds": POUND, "pound": POUND, "lbs": POUND, "lb": POUND, "ounces": OUNCE, "ounce": OUNCE, "oz": OUNCE, "cups": CUP, "cup": CUP}


def temperature(t, at):
    """(number, scale, end) of a reading of two or three digits at a place, else None; scale '' for a bare number."""
    end = at
    while end < len(t) and t[end] in "0123456789":
        end += 1
    if not 2 <= end - at <= 3 or at and t[at - 1] in "0123456789":
        return None
    n, rest = int(t[at:end]), t[end:]
    mark = next((m for m in ("°", "degrees", "degree") if rest.lstrip().lower().startswith(m)), "")
    word = rest.lstrip()[len(mark) :]
    name = re.match(r"\s*(\w*)", word, re.A)
    low = name[1].lower()
    if low in ("f",) or mark and low in ("fahrenheit", "c", "celsius"):
        return n, low[0].upper(), len(t) - len(word) + name.end()
    return (n, "", end) if not mark and not (low and low[0] in "fc") else None


def converted(text):
    x, out, at = plain(text or ""), "", 0
    while at < len(x):
        found = temperature(x, at) if x[at] in "0123456789" else None
        if found and found[1] != "C":
            inner = x[found[2] :].lstrip()
            second = temperature(inner, len(inner) - len(inner[1:].lstrip())) if inner[:1] in "([" and inner[:1] else None
            close = inner[second[2] :].lstrip() if second else ""
            if second and second[1] == "C" and close[:1] in (")", "]"):
                out, at = out + f"{second[0]}°C", len(x) - len(close) + 1
                continue
            if found[1] == "F":
                out, at = out + f"{half_up((found[0] - 32) * 5 / 9, 5)}°C", found[2]
                continue
        if x[at] in "0123456789":
            end = at
            while end < len(x) and x[end] in "0123456789":
                end += 1
            out, at = out + x[at:end], end
            continue
        out, at = out + x[at], at + 1
    short_of = lambda v, unit, big: short(v / 1000, 2) + " " + big if v >= 1000 else f"{int(v)} {unit}"

    def metric(m):
        v, word = number(re.sub(r"\s*/\s*", "/", m[1])), m[2].lower()
        if v is None or v > 1e15:
            return m[0]
        g = v * WORDS[word]
        if WORDS[word] == INCH:
            return (short(round(g * 2) / 2, 1) if g < 5 else str(round(g))) + " cm"
        weight = WORDS[word] != CUP
        step = (1 if g < 20 else 5 if g < 1000 else 25) if weight else (1 if g < 20 else 5 if g < 100 else 10 if g < 1000 else 50)
        return short_of(half_up(g, step), "g" if weight else "ml", "kg" if weight else "l")

    ends = "|".join(re.escape(w) + (r"\b" if w.isalpha() else r"(?!\w)" if w == "in." else "") for w in WORDS)
    new = re.sub(rf"(?i)((?:[0-9]+\s+)?[0-9]+\s*/\s*[0-9]+|[0-9]+(?:\.[0-9]+)?)[\s-]*({ends})", metric, out, flags=re.A)
    return (text if new == x else new,)


def diagnosed(x):
    for pattern, cause in classify.CAUSES.items():
        if re.search(pattern, x or "", re.I | re.A):
            return pattern in classify.RETRY, cause
    return True, classify.OTHER_CAUSE


def singular(w):
    w = w and w.lower()
    if not w or w in nouns.SINGULARS:
        return nouns.SINGULARS.get(w, w)
    if len(w) <= 3 or not w.endswith("s") or w.endswith(("ss", "us", "is")):
        return w
    return w[:-3] + "y" if w.endswith("ies") else w[:-2] if w.endswith(("ches", "shes", "xes", "zes", "sses", "oes")) else w[:-1]


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("whole"))
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    texts = dict(enumerate(ODD + real))
    spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string").repartition(8).write.parquet(f"{folder}/documents.parquet")
    return folder, texts


LINES = {"scale_servings": servings, "printed_metric": printed, "display_titles": shown, "parse_quantity": None, "find_timers": None}
TEXTS = {"convert_prose": converted, "diagnose_errors": diagnosed, "extract_time": None, "classify_recipes": None}


@pytest.mark.parametrize("name", [*LINES, *TEXTS])
def test_every_row(spark, held, name):
    folder, texts = held
    n = 2 if name in LINES else 1
    rows = __spark_entry__.queries()[name](spark, folder).collect()
    got = {tuple(r[:n]): tuple(r[n:]) for r in rows}
    inputs = {(i, k): x for i, t in texts.items() for k, x in enumerate([None] if t is None else t.split("\n"))} if n == 2 else {(i,): t for i, t in texts.items()}
    assert len(rows) == len(inputs) and set(got) == set(inputs)
    brute = (LINES | TEXTS)[name]
    assert brute is None or {k: (v, inputs[k]) for k, v in got.items() if v != brute(inputs[k])} == {}


def test_singular_words(spark, held):
    folder, texts = held
    words = Counter(w for t in texts.values() for w in ([None] if t is None else re.split(r"[ \t\n\r\f\v]+", t)))
    got = __spark_entry__.queries()["singular_words"](spark, folder).collect()
    assert len(got) == len(words) and {r.word: (r.n, r.singular) for r in got} == {w: (n, singular(w)) for w, n in words.items()}


def test_no_registered_query_holds_typed_rows():
    assert set(catalog.WHOLE) == {*LINES, *TEXTS, "singular_words"} <= set(__spark_entry__.queries())
    assert not any("(VALUES" in q for q in __spark_entry__.oracle_sql().values()) and not set(catalog.WHOLE) & set(__spark_entry__.oracle_sql())
