"""Ingredient lines with the built-in vocabulary: names, structs, scores, scaled and metric lines."""

import pytest
from pyspark.sql import functions as F

from galley import vocabulary
from galley.functions.scaling import scale_lines
from galley.operators import lines, names


@pytest.fixture(scope="module")
def words(spark):
    return vocabulary.frame(spark).cache()


def column(spark, values, name="line"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


NAMES = {
    "salad onions, trimmed": "scallion", "skin-on chicken thighs": "chicken thigh", "a large ripe avocado": "avocado", "soured cream": "sour cream", "mince of beef": "beef",
    "beef mince": "ground beef", "minced beef": "ground beef", "green peppers": "bell pepper", "pepper": "pepper", "cloves of garlic": "garlic", "garlic powder": "garlic powder",
    "Gruyère (aged)": "gruyere", "smoked harissa paste": "harissa paste", "tinned tomatoes": "canned tomato", "best-quality extra-virgin olive oil": "olive oil", "jasmine rice [rinsed]": "jasmine rice",
    "self raising flour": "self-rising flour", "(optional)": "", "": "", None: "", "unheard thing": "unheard thing", "powder": "powder", "ground cumin": "cumin",
}


def test_names(spark, words):
    rows = column(spark, list(NAMES), "phrase")
    got = {r.phrase: r.canonical for r in names.canonical(rows.union(rows), words).collect()}
    assert got == NAMES
    assert names.canonical(rows.limit(0), words).collect() == []


def test_a_name_of_any_length_is_found(spark):
    long = "extra fine dark brown soft sugar"
    known = spark.createDataFrame([("noun", long, None), ("noun", "sugar", None)], "kind string, key string, target string")
    assert names.canonical(column(spark, [f"some {long} lumps"], "phrase"), known).first().canonical == long


PARSED = {
    "3 ripe tomatoes, roughly chopped": [("tomato", "ripe tomatoes", 3.0, None, "roughly chopped", False)],
    "1/2 cup sugar plus more for the pan": [("sugar", "sugar", 0.5, "cup", "plus more for the pan", True)],
    "Pepper & salt": [("pepper", "pepper", None, None, "", True), ("salt", "salt", None, None, "", True)],
    "fish and something odd": [("fish something odd", "fish and something odd", None, None, "", False)],
    "2 tbsp [30 ml] honey (runny), warmed": [("honey", "honey", 2.0, "tbsp", "warmed", False)],
    "pasta, penne": [("penne", "pasta, penne", None, None, "", False)],
    "100 g crème fraîche and 2 eggs": [("creme fraiche", "crème fraîche", 100.0, "g", "", False), ("egg", "2 eggs", None, None, "", False)],
    "(for later)": [],
}


def test_structs(spark, words):
    got = {r.line: [tuple(i) for i in r.ingredients] for r in lines.parse_lines(column(spark, [*PARSED, None, "", "  "]), words).collect()}
    assert got == PARSED


def test_first_mention_wins(spark, words):
    rows = [(1, 0, "salt and pepper"), (1, 1, "2 eggs"), (1, 2, "1 tsp salt, more or less"), (1, 3, None), (1, 4, "a pinch of pepper"), (2, 5, "1 tsp salt"), (2, 5, "2 onions"), (None, 0, "rice")]
    got = lines.recipe_ingredients(spark.createDataFrame(rows, "recipe int, position int, line string"), words).collect()
    found = sorted((str(r.recipe), r.position, r.canonical, r.quantity) for r in got)
    assert found == [("1", 0, "salt", None), ("1", 1, "pepper", None), ("1", 2, "egg", 2.0), ("2", 0, "salt", 1.0), ("2", 1, "onion", 2.0), ("None", 0, "rice", None)]


SCORES = {
    "250 ml whole milk": 1.0, "salt": 0.5, "a few sprigs of thyme": 1.0, "Baked Sea Bass with Fennel": 0.0, "Rice Pudding 2": 0.05, "fennel, 12, 80-81": 0.0, "For the glaze:": 0.0, "Dressing": 0.0,
    "Simmer the stock gently for a long while until it has reduced by about half, then strain.": 0.0, "2 spare parts": 0.6, "x" * 201: 0.0, "": 0.0, " - ": 0.0, "dried cherries": 0.5, "blackcurrant powder": 0.35,
}


def test_scores(spark, words):
    got = {r.line: r.score for r in lines.score_lines(column(spark, [*SCORES, None]), words).collect()}
    assert got == pytest.approx(SCORES)


def test_marked_blocks(spark, words):
    rows = [(1, "item", None, "olives or so"), (2, "text", None, "olives or so"), (3, "heading", 2, "2 cups rice"), (4, "image", None, "2 cups rice"), (5, "text", None, "2 cups rice"), (6, "text", None, None), (7, "text", None, "2 cups " + "rice " * 30)]
    frame = spark.createDataFrame(rows, "position int, kind string, level int, text string")
    assert {r.position for r in lines.mark_lines(frame, words).where("is_line").collect()} == {1, 5}


SCALED = [
    ("3 tablespoons capers", 2, "6 tablespoons capers"), ("¾ cup cream", 2, "1½ cups cream"), ("2-1/2 pounds beef", 2, "5 pounds beef"), ("1 to 2 pints stock", 0.5, "½ to 1 pint stock"),
    ("Topping: 2 cups oats", 0.5, "Topping: 1 cup oats"), ("roughly 4 cups peas", 0.25, "roughly 1 cup peas"), ("1.2 kg potatoes", 1.5, "1.8 kg potatoes"), ("900 ml milk", 2, "1.8 l milk"),
    ("30 g butter", 0.5, "15 g butter"), ("2 cups (300 g) rice", 0.5, "1 cup (150 g) rice"), ("100 g / 4 oz sugar (about 2 cups)", 2, "200 g / 8 oz sugar (about 4 cups)"), ("3 (12-oz) bottles beer", 2, "6 (12-oz) bottles beer"),
    ("1 box", 3, "3 boxes"), ("1 (9-inch) tortilla", 4, "4 (9-inch) tortillas"), ("3 x 200 g blocks tofu", 2, "6 x 200 g blocks tofu"), ("2 potatoes, halved", 0.5, "1 potato, halved"),
    ("1 Egg", 2, "2 Eggs"), ("Three leeks", 2, "6 leeks"), ("Juice of 2 limes", 0.5, "Juice of 1 lime"), ("Mint (1 bunch)", 3, "Mint (3 bunches)"), ("1 bay leaf or 2", 2, "2 bay leaves or 2"), ("2 sticks celery", 0.5, "1 stick celery"),
    ("10 carrots", 1.25, "12½ carrots"), ("21 prunes", 2, "42 prunes"), ("½ tsp. salt", 0.1, "⅛ tsp salt"),
]
KEPT = ["Sea salt", "9-inch pie crust", "50% cream", "2. Fold in the eggs.", "see page 20", "", "1/0 cup rice", '12" skewers']


def test_scaled_lines(spark):
    rows = [(a, float(f), b, True) for a, f, b in SCALED] + [(k, 2.0, k, False) for k in KEPT] + [("2 cups rice", 1.0, "2 cups rice", False), ("2 cups rice", None, "2 cups rice", False), (None, 2.0, None, False)]
    frame = spark.createDataFrame(rows, "line string, f double, right string, differs boolean")
    got = scale_lines(frame, F.col("f"))
    assert got.columns == [*frame.columns, "scaled", "changed"]
    assert [(r.line, r.scaled, r.changed) for r in got.collect()] == [(a, b, c) for a, _, b, c in rows]


METRIC = {
    "3 cups sugar": "600 g sugar", "1 cup chicken stock": "240 ml chicken stock", "2 lb beef, cubed": "905 g beef, cubed", "1 quart water": "950 ml water", "12 inches rope": "30.5 cm rope", "1 cup unknown paste": "240 ml unknown paste",
    "½ cup cocoa, plus more for dusting": "50 g cocoa, plus more for dusting", "1 cup (250 ml) milk , warm": "250 ml milk, warm", "1 oz (28 g)": "1 oz (28 g)", "3 tbsp (1½ oz) butter": "3 tbsp (45 g) butter", "200 g rice": "200 g rice",
    "a 9-inch tin": "a 23 cm tin", "salt": "salt", "": "", "  ": "  ",
}


def test_metric_lines(spark, words):
    got = {r.line: r.metric for r in lines.metric_lines(column(spark, [*METRIC, None]), words).collect()}
    assert got == METRIC
