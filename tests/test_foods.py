"""Diets, allergens and aisles with the built-in classes."""

from pyspark.sql import functions as F

from galley import foods
from galley.operators import diet

RECIPES = {
    1: ["tofu", "soy sauce", "sesame oil", "rice"], 2: ["salmon", "butter"], 3: ["parmesan", "pasta", "garlic"], 4: ["chicken stock", "leek"], 5: ["honey", "oat"], 6: ["shrimp", "dark chocolate", "moon dust"],
    7: ["fish sauce", "worcestershire sauce", "lamb"], 8: ["gelatin", "sugar"], 9: ["lentil", "carrot", "cumin"], 10: ["scallop", "rum"],
}
# allergens, diets, unknown
RIGHT = {
    1: ("gluten,sesame,soy", "no red meat,pescatarian,vegan,vegetarian", ""), 2: ("fish,milk", "no red meat,pescatarian", ""), 3: ("gluten,milk", "no red meat,pescatarian,vegetarian", ""),
    4: ("", "no red meat", ""), 5: ("", "no red meat,pescatarian,vegetarian", ""), 6: ("crustaceans", "no red meat,pescatarian", "moon dust"), 7: ("fish", "", ""), 8: ("", "no red meat", ""),
    9: ("", "no red meat,pescatarian,vegan,vegetarian", ""), 10: ("molluscs", "no red meat,pescatarian", "rum"),
}
AISLES = {
    "garlic": "Fruit & veg", "broccoli floret": "Fruit & veg", "pita": "Bakery", "boneless beef short rib": "Meat", "beef stock": "Tins, jars & sauces", "cod": "Fish & seafood", "tuna": "Tins, jars & sauces", "fish sauce": "Tins, jars & sauces",
    "milk chocolate chip": "Dry goods & baking", "goat cheese": "Dairy, eggs & chilled", "tofu": "Dairy, eggs & chilled", "garlic powder": "Herbs & spices", "cocoa powder": "Dry goods & baking", "sherry vinegar": "Oils & vinegars",
    "coconut": "Dry goods & baking", "pea": "Frozen", "pecan": "Dry goods & baking", "beer": "Drinks", "rice": "Dry goods & baking", "potato": "Fruit & veg", "gadget": "Other", "": "Other", None: None,
}


def test_diets_and_allergens(spark):
    lines = spark.createDataFrame([(r, n) for r, names in RECIPES.items() for n in names], "recipe_id int, canonical string")
    found = diet.profile(lines, foods.classes(spark), foods.allergens(spark))
    text = lambda c: F.array_join(c, ",").alias(c)
    got = {r.recipe_id: tuple(r)[1:] for r in found.select("recipe_id", text("allergens"), text("diets"), text("unknown")).collect()}
    assert got == RIGHT
    told = {r.recipe_id: r.notes for r in diet.notes(lines, foods.notes(spark), found).collect()}
    assert told[1] == ["soy sauce usually contains wheat"] and told[3] == ["made with animal rennet: parmesan"] and told[4] == []
    assert told[7] == ["contains a fish-based sauce"] and told[6] == ["dark chocolate is often made on shared dairy equipment"]


def test_aisles(spark):
    rows = spark.createDataFrame([(k,) for k in AISLES], "c string").select("c", foods.aisle(F.col("c")).alias("aisle")).collect()
    assert {r.c: r.aisle for r in rows} == AISLES and {a for a in AISLES.values() if a} <= set(foods.AISLES)
    named = spark.createDataFrame([("bean", "frozen beans")], "c string, n string").select(foods.aisle(F.col("c"), F.col("n")))
    assert named.first()[0] == "Frozen"
