"""What ingredients are: classes and allergens for diets, and the aisle of a shop, by canonical name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley import vocabulary

# Classes of ingredients that diets are decided by.
RED_MEAT = (
    "beef", "steak", "brisket", "short rib", "ground beef", "veal", "pork", "pork belly", "pork chop", "bacon", "pancetta", "prosciutto", "ham", "chorizo",
    "salami", "lamb", "lamb chop", "mutton", "venison", "oxtail", "ground pork", "ground lamb", "beef stock", "liver", "sausage", "mince",
)
OTHER_MEAT = (
    "chicken", "chicken breast", "chicken thigh", "chicken wing", "turkey", "duck", "goose", "quail", "rabbit", "chicken stock", "lard", "gelatin", "suet",
    "duck fat", "merguez",
)
FISH = (
    "fish", "salmon", "tuna", "cod", "haddock", "halibut", "sea bass", "snapper", "trout", "mackerel", "sardine", "anchovy", "herring", "sole", "plaice",
    "monkfish", "fish stock", "fish sauce", "dashi", "salt cod", "worcestershire sauce", "gravlax", "bonito",
)
CRUSTACEANS = ("shrimp", "prawn", "crab", "lobster", "langoustine", "crayfish", "scampi")
MOLLUSCS = ("scallop", "mussel", "clam", "oyster", "squid", "octopus", "calamari", "cuttlefish", "whelk", "winkle")
MILK = (
    "milk", "buttermilk", "cream", "heavy cream", "light cream", "sour cream", "creme fraiche", "yogurt", "greek yogurt", "butter", "ghee", "cheese",
    "cheddar", "parmesan", "mozzarella", "feta", "ricotta", "mascarpone", "halloumi", "gruyere", "brie", "goat cheese", "blue cheese", "cream cheese",
    "manchego", "paneer", "condensed milk", "evaporated milk", "custard", "ice cream", "labneh", "kefir", "clotted cream", "whey", "casein", "chocolate",
    "milk chocolate", "white chocolate", "nutella",
)
EGG = ("egg", "egg white", "egg yolk", "mayonnaise", "meringue", "aioli")
RENNET = ("parmesan", "gruyere", "manchego", "pecorino", "grana padano")
# The other allergens and what carries them.
GLUTEN = (
    "flour", "bread flour", "self-rising flour", "bread", "breadcrumb", "panko", "pasta", "spaghetti", "penne", "fusilli", "linguine", "tagliatelle",
    "fettuccine", "macaroni", "lasagna", "noodle", "ramen", "udon", "vermicelli", "gnocchi", "couscous", "bulgur", "barley", "semolina", "farro", "rye",
    "spelt", "seitan", "pita", "naan", "baguette", "brioche", "crouton", "tortilla", "puff pastry", "filo", "phyllo", "beer", "soy sauce", "hoisin",
    "oyster sauce", "miso", "orzo", "flatbread", "focaccia", "digestive biscuit", "cracker", "pretzel", "wheat", "gochujang",
)
NUTS = (
    "almond", "walnut", "pecan", "cashew", "pistachio", "hazelnut", "macadamia", "brazil nut", "pine nut", "chestnut", "praline", "marzipan", "nutella",
    "almond flour", "almond milk", "frangipane",
)
ALLERGENS = {
    "gluten": GLUTEN, "crustaceans": CRUSTACEANS, "egg": EGG, "fish": FISH, "peanuts": ("peanut", "peanut butter", "peanut oil", "satay"),
    "soy": ("soy sauce", "tofu", "tempeh", "edamame", "miso", "tamari", "soy milk", "hoisin", "gochujang", "doubanjiang", "ponzu", "seitan"), "milk": MILK,
    "nuts": NUTS, "celery": ("celery", "celeriac", "celery salt"), "mustard": ("mustard", "dijon mustard", "mustard seed", "wholegrain mustard"),
    "sesame": ("sesame seed", "sesame oil", "tahini", "hummus", "zaatar"),
    "sulphites": ("wine", "white wine", "red wine", "sherry", "port", "vermouth", "cider", "balsamic vinegar", "wine vinegar", "white wine vinegar", "red wine vinegar", "dried apricot", "raisin", "sultana", "molasses"),
    "molluscs": MOLLUSCS,
}
# Names of plants and the like that nobody vouches for, and names outside the vocabulary that are safe.
UNSURE = (
    "rutabaga", "yam", "mandarin", "nectarine", "papaya", "currant", "soba", "treacle", "fenugreek", "cilantro", "herbes de provence", "sherry vinegar",
    "stock", "brandy", "rum", "whiskey", "vodka", "sake", "mirin", "cream of coconut", "cornflake",
)
ALSO_SAFE = ("white pepper", "sunflower oil", "cooking spray", "vanilla extract", "red onion", "plantain")
# What a reader is told beside the diets, in this order.
NOTES = {
    "soy sauce": "soy sauce usually contains wheat", "dark chocolate": "dark chocolate is often made on shared dairy equipment",
    "worcestershire sauce": "contains a fish-based sauce", "fish sauce": "contains a fish-based sauce",
}
# Aisles in the order of a walk round a shop.
AISLES = (
    "Fruit & veg", "Bakery", "Meat", "Fish & seafood", "Dairy, eggs & chilled", "Dry goods & baking", "Tins, jars & sauces", "Oils & vinegars",
    "Herbs & spices", "Frozen", "Drinks", "Other",
)
# Names, words of names, last words and parts of words that place an ingredient in an aisle.
PRODUCE = (
    "garlic", "garlic bulb", "onion", "red onion", "shallot", "scallion", "leek", "green onion top", "green onion white green part", "spring onion",
    "lemon", "lime", "orange", "grapefruit", "bell pepper", "carrot", "tomato", "cherry tomato", "potato", "sweet potato", "avocado", "ginger", "parsley",
    "parsley leaf", "cilantro", "cilantro leaf", "coriander", "basil", "mint", "mint leaf", "dill", "chive", "rosemary", "thyme", "sage", "tarragon",
    "spinach", "kale", "lettuce", "arugula", "rocket", "cucumber", "cabbage", "celery", "celery rib", "mushroom", "zucchini", "courgette", "squash",
    "eggplant", "aubergine", "broccoli", "broccolini", "cauliflower", "asparagus", "green bean", "corn", "radish", "beet", "beetroot", "parsnip",
    "artichoke", "brussels sprout", "jalapeno", "green chile", "chili", "chilli", "fennel", "bok choy", "pumpkin", "banana", "apple", "pear", "peach",
    "nectarine", "plum", "mango", "pineapple", "strawberry", "raspberry", "blueberry", "blackberry", "cherry", "grape", "kiwifruit", "apricot",
    "cranberry", "fig", "melon", "watermelon", "pomegranate", "sprout", "bean sprout", "turnip", "swede", "okra", "tomatillo", "snow pea", "snap pea",
    "coleslaw mix", "bag coleslaw mix",
)
PRODUCE_LAST = ("onion", "tomato", "lettuce", "squash", "berry", "potato", "mushroom", "cabbage", "chile", "greens", "apple", "juice")
SPICES = (
    "salt", "black pepper", "pepper", "cinnamon", "paprika", "cumin", "oregano", "nutmeg", "turmeric", "chili powder", "curry powder", "allspice",
    "cardamom", "bay leaf", "sumac", "za atar", "zaatar", "seven spice", "italian seasoning", "taco seasoning", "garlic powder", "onion powder",
    "chili flake", "clove", "fennel seed", "cumin seed", "mustard seed", "star anise", "saffron", "cayenne", "garam masala", "ranch seasoning powder",
    "chicken bouillon powder", "herbes de provence", "five spice", "smoked paprika", "black peppercorn", "peppercorn", "caraway", "msg", "lavender",
    "culinary-grade lavender",
)
SPICE_PARTS = ("ground ", "dried ", "powder", "flake", "seasoning", "spice")
NO_SPICE_PARTS = ("protein", "baking", "cocoa", "cacao", "sugar", "arrowroot", "espresso", "coffee", "coconut", "collagen", "flour", "starch")
BAKERY = (
    "bread", "tortilla", "bun", "pita", "bagel", "naan", "roll", "brioche", "croissant", "baguette", "flatbread", "english muffin", "wrap", "sourdough",
    "focaccia", "ciabatta",
)
TINS = (
    "coconut milk", "tomato puree", "tomato paste", "chickpea", "black bean", "kidney bean", "cannellini bean", "butter bean", "bean", "pumpkin puree",
    "marinara sauce", "salsa", "soy sauce", "coconut amino", "sriracha", "ketchup", "worcestershire sauce", "fish sauce", "mustard", "dijon mustard",
    "mayonnaise", "honey", "maple syrup", "molasses", "syrup", "peanut butter", "almond butter", "tahini", "miso", "kimchi", "pickle", "olive", "caper",
    "applesauce", "jam", "hoisin", "gochujang", "hot sauce", "salsa verde", "tuna", "anchovy", "sardine", "canned tomato", "mirin",
)
TIN_PARTS = ("broth", "stock", "sauce", "paste", "puree", "syrup", "bouillon", "pesto", "dressing", "salsa", "tamari", "spread", "fluff")
DRY_PARTS = (
    "flour", "sugar", "rice", "pasta", "spaghetti", "noodle", "oat", "cocoa", "cacao", "chocolate", "extract", "seed", "flaxseed", "quinoa", "lentil",
    "cornstarch", "cornmeal", "polenta", "starch", "yeast", "baking powder", "baking soda", "protein powder", "collagen", "panko", "breadcrumb", "cracker",
    "raisin", "date", "coconut flake", "couscous", "bulgur", "gelatin", "arrowroot", "vanilla", "sprinkle", "granola", "cereal", "chex", "espresso",
    "currant", "penne", "macaroni", "orzo", "lasagna", "barley", "split pea", "prune", "linguine", "fettuccine", "tagliatelle", "rigatoni", "fusilli",
    "farfalle", "vermicelli", "ramen", "udon", "farro", "pretzel", "marshmallow", "caramel", "toffee", "candy", "cookie", "popcorn", "pudding mix",
    "cake mix", "hemp heart",
)
BAKING_PARTS = ("vanilla", "extract", "shortening", "peanut", "coconut")
DRINKS = (
    "wine", "red wine", "white wine", "beer", "coffee", "tea", "espresso", "sparkling water", "cider", "rum", "vodka", "brandy", "sherry", "port",
    "vermouth", "sake",
)
MEAT_WORDS = (
    "beef", "pork", "chicken", "lamb", "turkey", "bacon", "sausage", "steak", "ham", "veal", "duck", "mince", "chorizo", "prosciutto", "pancetta",
    "brisket", "butt", "loin",
)
FISH_WORDS = ("fish", "salmon", "tuna", "cod", "shrimp", "prawn", "crab", "scallop", "mussel", "clam", "trout", "halibut", "haddock")
DAIRY_WORDS = ("cheese", "milk", "cream", "yogurt", "yoghurt", "egg", "eggs", "queso", "half-and-half")
CHILLED = ("tofu", "tempeh", "hummus", "fresh pasta", "gnocchi", "pizza dough", "refrigerated pizza dough", "phyllo dough", "puff pastry")
FROZEN = ("pea", "edamame", "potato tot", "ice cream", "ice")
PROCESSED_PARTS = ("stock", "broth", "bouillon", "gelatin", "lard", "fat", "powder", "sauce")


def safe() -> list[str]:
    """Names known to carry nothing: those of plants and the larder that are in no class and not unsure, and some more."""
    classed = {n for group in (RED_MEAT, OTHER_MEAT, *ALLERGENS.values()) for n in group}
    plants = [n for g, names in vocabulary.GROUPS.items() if g not in ("meat", "seafood", "dairy") for n in names]
    return sorted({n for n in (*plants, *ALSO_SAFE) if n not in classed and n not in UNSURE})


def classes(spark: SparkSession) -> DataFrame:
    """(canonical, class) for diet.profile."""
    groups = {"red meat": RED_MEAT, "meat": RED_MEAT + OTHER_MEAT, "fish": FISH, "crustacean": CRUSTACEANS, "mollusc": MOLLUSCS, "dairy": MILK, "egg": EGG, "rennet cheese": RENNET, "safe": tuple(safe())}
    # Some rennet cheeses are in no other class: they are noted, but not known.
    known = {n for c, group in groups.items() if c != "rennet cheese" for n in group}
    rows = [(n, c) for c, group in groups.items() for n in group if c != "rennet cheese" or n in known]
    return spark.createDataFrame([*rows, ("honey", "honey")], "canonical string, class string")


def allergens(spark: SparkSession) -> DataFrame:
    """(canonical, allergen) for diet.profile."""
    return spark.createDataFrame([(n, a) for a, group in ALLERGENS.items() for n in group], "canonical string, allergen string")


def notes(spark: SparkSession) -> DataFrame:
    """(canonical, rank, note) for diet.notes."""
    rows = [(n, list(dict.fromkeys(NOTES.values())).index(t), t) for n, t in NOTES.items()]
    return spark.createDataFrame(rows, "canonical string, rank int, note string")


def aisle(canonical: Column, name: Column | None = None) -> Column:
    """The aisle of a shop by a cascade of rules, the first that holds; name is what the book calls the ingredient. Other
    where none does; null stays null."""
    text = F.lower(F.concat_ws(" ", canonical, F.lit("") if name is None else name))
    words = F.split(canonical, " ")
    last = F.element_at(words, -1)
    part = lambda c, parts: reduce(lambda a, b: a | b, (c.contains(p) for p in parts))
    word = lambda known: F.exists(words, lambda w: w.isin(*known))
    fresh, dry = ~part(canonical, PROCESSED_PARTS), part(canonical, DRY_PARTS)
    produce = canonical.isin(*PRODUCE) | last.isin(*PRODUCE_LAST) | (word([p for p in PRODUCE if " " not in p]) & ~dry)
    rules = (
        (text.contains("frozen") | canonical.isin(*FROZEN), "Frozen"), (canonical.isin(*TINS), "Tins, jars & sauces"),
        ((canonical.isin(*FISH, *CRUSTACEANS, *MOLLUSCS) | word(FISH_WORDS)) & fresh, "Fish & seafood"),
        ((canonical.isin(*RED_MEAT, *OTHER_MEAT) | word(MEAT_WORDS) | canonical.contains("short rib")) & fresh, "Meat"),
        (canonical.isin(*CHILLED) | ((canonical.isin(*MILK, *EGG) | word(DAIRY_WORDS)) & ~canonical.contains("chocolate")), "Dairy, eggs & chilled"),
        (canonical.isin(*SPICES) | (part(text, SPICE_PARTS) & ~part(text, NO_SPICE_PARTS)), "Herbs & spices"),
        (part(canonical, ("oil", "vinegar", "spray")), "Oils & vinegars"), (part(canonical, BAKING_PARTS), "Dry goods & baking"), (produce, "Fruit & veg"),
        (canonical.isin(*BAKERY) | last.isin(*BAKERY), "Bakery"), (part(canonical, TIN_PARTS), "Tins, jars & sauces"),
        (canonical.isin(*NUTS) | (last == "nut") | dry, "Dry goods & baking"), (canonical.isin(*DRINKS), "Drinks"),
    )
    found = reduce(lambda c, rule: c.when(*rule), rules[1:], F.when(*rules[0]))
    return F.when(canonical.isNotNull(), found.otherwise("Other"))
