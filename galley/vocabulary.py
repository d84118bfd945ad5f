"""Words that recipe lines are read with, and the table of them that operators join. Users may pass tables of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.functions.measures import UNITS

# Words that say how food is prepared, sized or sold, not what it is.
DESCRIPTORS = (
    "fresh", "freshly", "dried", "dry", "frozen", "thawed", "canned", "tinned", "jarred", "bottled", "raw", "cooked", "uncooked", "precooked", "leftover",
    "ripe", "unripe", "overripe", "firm", "soft", "hard", "tender", "large", "small", "medium", "big", "little", "tiny", "extra", "jumbo", "baby", "young",
    "mature", "whole", "halved", "quartered", "chopped", "finely", "coarsely", "roughly", "minced", "diced", "sliced", "thinly", "thickly", "shredded",
    "grated", "ground", "crushed", "cracked", "julienned", "cubed", "torn", "shaved", "peeled", "unpeeled", "seeded", "deseeded", "cored", "stemmed",
    "trimmed", "rinsed", "washed", "drained", "boneless", "skinless", "bone-in", "skin-on", "lean", "fatty", "softened", "melted", "cooled", "warmed",
    "chilled", "room", "temperature", "unsalted", "salted", "sweetened", "unsweetened", "plain", "natural", "pure", "organic", "virgin", "extra-virgin",
    "light", "heavy", "full-fat", "low-fat", "reduced-fat", "nonfat", "fat-free", "good-quality", "best-quality", "quality", "store-bought", "homemade",
    "packed", "lightly", "loosely", "heaping", "level", "scant", "generous", "approximately", "about", "optional", "divided", "plus", "more", "needed",
    "taste", "garnish", "serving", "drizzling", "thick", "thin", "fine", "coarse", "long", "short", "round", "flat", "toasted", "roasted", "smoked",
    "cured", "pickled", "fermented", "boiling", "hot", "cold", "lukewarm", "warm", "iced", "all-purpose", "granulated", "caster", "confectioners",
    "powdered", "superfine", "skimmed", "semi-skimmed", "whole-milk", "finely-chopped", "roughly-chopped",
)
# Small words inside a name.
SMALL = ("of", "and", "or", "the", "a", "an", "with", "into", "in", "on", "to", "for", "from", "such", "as", "any", "very")
# What a handling note begins with.
NOTES = (
    " plus more", " plus extra", " to taste", " for garnish", " for serving", " for drizzling", " for brushing", " for dusting", " for frying",
    " for greasing", " if needed", " if desired", " or to taste", " at room temperature", " divided", " optional",
)
# Labels inside a list.
SUBHEADS = ("for", "the", "sauce", "dressing", "filling", "topping", "crust", "dough", "marinade", "glaze", "garnish", "base", "batter", "frosting", "icing", "assembly", "serve")
# What every kitchen has.
STAPLES = (
    "salt", "pepper", "black pepper", "white pepper", "water", "ice", "olive oil", "vegetable oil", "cooking oil", "sunflower oil", "canola oil", "oil",
    "cooking spray", "butter", "sugar", "flour", "baking powder", "baking soda", "vanilla extract",
)
# Verbs that steps of a method begin with.
VERBS = (
    "add", "adjust", "arrange", "assemble", "bake", "baste", "beat", "blanch", "blend", "boil", "bring", "broil", "brown", "brush", "bubble", "carve",
    "chill", "chop", "coat", "combine", "cook", "cool", "cover", "cream", "crush", "cut", "deglaze", "dice", "dip", "divide", "drain", "dress", "drizzle",
    "drop", "dust", "fill", "flip", "fold", "fry", "garnish", "grate", "grease", "grill", "grind", "heat", "knead", "layer", "leave", "lift", "line",
    "mash", "melt", "mix", "moisten", "pat", "peel", "place", "poach", "position", "pour", "preheat", "press", "prick", "puree", "reduce", "refrigerate",
    "remove", "repeat", "reserve", "return", "rinse", "roast", "roll", "rub", "scatter", "scrape", "season", "serve", "set", "shake", "simmer", "skim",
    "slice", "soak", "spoon", "spread", "sprinkle", "squeeze", "steam", "stir", "strain", "stuff", "swirl", "taste", "tip", "toast", "toss", "transfer",
    "trim", "turn", "using", "wait", "warm", "wash", "whip", "whisk", "wipe", "work", "wrap",
)
# Names of ingredients, by what they are.
VEGETABLES = (
    "onion", "shallot", "garlic", "leek", "scallion", "chive", "celery", "carrot", "parsnip", "turnip", "rutabaga", "potato", "sweet potato", "yam", "beet",
    "radish", "fennel", "cabbage", "kale", "spinach", "chard", "lettuce", "arugula", "watercress", "broccoli", "cauliflower", "brussels sprout",
    "asparagus", "artichoke", "zucchini", "squash", "pumpkin", "cucumber", "eggplant", "tomato", "cherry tomato", "pepper", "bell pepper", "chili",
    "jalapeno", "habanero", "mushroom", "corn", "pea", "green bean", "snow pea", "snap pea", "okra", "avocado", "olive", "caper", "pickle", "sauerkraut", "kimchi",
)
FRUIT = (
    "apple", "pear", "banana", "orange", "lemon", "lime", "grapefruit", "mandarin", "peach", "nectarine", "plum", "apricot", "cherry", "strawberry",
    "raspberry", "blueberry", "blackberry", "cranberry", "grape", "melon", "watermelon", "mango", "pineapple", "papaya", "kiwi", "fig", "date", "raisin",
    "currant", "prune", "coconut", "pomegranate", "rhubarb",
)
MEATS = (
    "chicken", "chicken breast", "chicken thigh", "chicken wing", "turkey", "duck", "goose", "quail", "beef", "steak", "brisket", "short rib",
    "ground beef", "veal", "pork", "pork belly", "pork chop", "sausage", "bacon", "pancetta", "prosciutto", "ham", "chorizo", "salami", "lamb",
    "lamb chop", "mutton", "rabbit", "venison", "liver", "oxtail", "mince",
)
SEAFOOD = (
    "fish", "salmon", "tuna", "cod", "haddock", "halibut", "sea bass", "snapper", "trout", "mackerel", "sardine", "anchovy", "herring", "sole", "plaice",
    "monkfish", "shrimp", "prawn", "crab", "lobster", "scallop", "mussel", "clam", "oyster", "squid", "octopus", "calamari",
)
DAIRY = (
    "egg", "egg white", "egg yolk", "milk", "buttermilk", "cream", "heavy cream", "sour cream", "creme fraiche", "yogurt", "greek yogurt", "butter",
    "ghee", "cheese", "cheddar", "parmesan", "mozzarella", "feta", "ricotta", "mascarpone", "halloumi", "gruyere", "brie", "goat cheese", "blue cheese", "cream cheese",
)
GRAINS = (
    "rice", "basmati rice", "arborio rice", "jasmine rice", "brown rice", "wild rice", "quinoa", "couscous", "bulgur", "barley", "farro", "oat",
    "oatmeal", "polenta", "cornmeal", "semolina", "pasta", "spaghetti", "penne", "fusilli", "linguine", "tagliatelle", "fettuccine", "macaroni",
    "lasagna", "noodle", "ramen", "udon", "soba", "rice noodle", "vermicelli", "gnocchi", "bread", "breadcrumb", "panko", "tortilla", "pita", "naan",
    "baguette", "brioche", "crouton",
)
BAKING = (
    "flour", "bread flour", "self-rising flour", "cornstarch", "yeast", "baking powder", "baking soda", "sugar", "brown sugar", "powdered sugar",
    "honey", "maple syrup", "syrup", "molasses", "treacle", "chocolate", "cocoa", "dark chocolate", "white chocolate", "chocolate chip",
)
PULSES = (
    "bean", "black bean", "kidney bean", "cannellini bean", "butter bean", "chickpea", "lentil", "red lentil", "split pea", "tofu", "tempeh", "seitan",
    "edamame", "almond", "walnut", "pecan", "cashew", "pistachio", "hazelnut", "peanut", "pine nut", "macadamia", "sesame seed", "sunflower seed",
    "pumpkin seed", "poppy seed", "chia seed", "flaxseed",
)
SPICES = (
    "salt", "black pepper", "paprika", "cumin", "coriander", "cardamom", "cinnamon", "nutmeg", "clove", "allspice", "turmeric", "ginger", "saffron",
    "vanilla", "bay leaf", "oregano", "thyme", "rosemary", "sage", "basil", "parsley", "cilantro", "dill", "mint", "tarragon", "marjoram", "fenugreek",
    "star anise", "fennel seed", "mustard seed", "caraway", "sumac", "zaatar", "garam masala", "curry powder", "chili powder", "chili flake", "cayenne",
    "five spice", "herbes de provence",
)
LARDER = (
    "oil", "olive oil", "vegetable oil", "sesame oil", "coconut oil", "peanut oil", "canola oil", "vinegar", "balsamic vinegar", "white wine vinegar",
    "red wine vinegar", "rice vinegar", "apple cider vinegar", "sherry vinegar", "stock", "chicken stock", "beef stock", "vegetable stock", "fish stock",
    "dashi", "wine", "white wine", "red wine", "sherry", "port", "vermouth", "brandy", "rum", "whiskey", "vodka", "beer", "cider", "sake", "mirin",
    "soy sauce", "fish sauce", "worcestershire sauce", "hot sauce", "sriracha", "tabasco", "harissa", "miso", "tahini", "hummus", "mayonnaise", "mustard",
    "dijon mustard", "ketchup", "tomato puree", "canned tomato", "passata", "coconut milk", "cream of coconut", "peanut butter", "jam", "marmalade",
    "gelatin", "cornflake", "raisin bran", "nutritional yeast", "coffee", "espresso", "tea", "water", "ice", "lemon zest", "orange zest",
)
GROUPS = {
    "vegetable": VEGETABLES, "fruit": FRUIT, "meat": MEATS, "seafood": SEAFOOD, "dairy": DAIRY, "grain": GRAINS, "baking": BAKING, "pulse": PULSES,
    "spice": SPICES, "larder": LARDER,
}
# Other names of an ingredient. Plurals of names need no row, as words are made singular.
SYNONYMS = {
    "spring onion": "scallion", "green onion": "scallion", "salad onion": "scallion", "coriander leaves": "coriander", "cilantro": "coriander",
    "aubergine": "eggplant", "courgette": "zucchini", "rocket": "arugula", "capsicum": "bell pepper", "sweet pepper": "bell pepper",
    "garbanzo bean": "chickpea", "garbanzo": "chickpea", "coriander seed": "coriander", "beetroot": "beet", "swede": "rutabaga", "mange tout": "snow pea",
    "mangetout": "snow pea", "sugar snap": "snap pea", "double cream": "heavy cream", "whipping cream": "heavy cream", "single cream": "light cream",
    "soured cream": "sour cream", "natural yogurt": "yogurt", "yoghurt": "yogurt", "greek yoghurt": "greek yogurt", "cornflour": "cornstarch",
    "corn flour": "cornstarch", "plain flour": "flour", "all purpose flour": "flour", "ap flour": "flour", "strong flour": "bread flour",
    "self raising flour": "self-rising flour", "icing sugar": "powdered sugar", "confectioners sugar": "powdered sugar", "caster sugar": "sugar",
    "granulated sugar": "sugar", "white sugar": "sugar", "demerara": "brown sugar", "muscovado": "brown sugar", "bicarbonate of soda": "baking soda",
    "bicarb": "baking soda", "prawn": "shrimp", "king prawn": "shrimp", "mince": "ground beef", "minced beef": "ground beef", "beef mince": "ground beef",
    "ground beef": "ground beef", "ground pork": "ground pork", "ground lamb": "ground lamb", "ground turkey": "ground turkey",
    "ground chicken": "ground chicken", "ground veal": "ground veal", "minced pork": "ground pork", "pork mince": "ground pork",
    "minced lamb": "ground lamb", "streaky bacon": "bacon", "back bacon": "bacon", "gammon": "ham", "stock cube": "stock", "bouillon": "stock",
    "broth": "stock", "chicken broth": "chicken stock", "beef broth": "beef stock", "vegetable broth": "vegetable stock", "passata": "tomato puree",
    "tomato paste": "tomato puree", "tinned tomatoes": "canned tomato", "chopped tomatoes": "canned tomato", "plum tomatoes": "tomato",
    "cherry tomatoes": "cherry tomato", "chilli": "chili", "chile": "chili", "chilli flakes": "chili flake", "red pepper flakes": "chili flake",
    "chilli powder": "chili powder", "paprika sweet": "paprika", "soy": "soy sauce", "shoyu": "soy sauce", "tamari": "soy sauce",
    "fish sauce nam pla": "fish sauce", "nam pla": "fish sauce", "parmigiano": "parmesan", "parmigiano reggiano": "parmesan", "grana padano": "parmesan",
    "mozzarella cheese": "mozzarella", "cheddar cheese": "cheddar", "feta cheese": "feta", "goats cheese": "goat cheese", "linguini": "linguine",
    "spaghetti pasta": "spaghetti", "risotto rice": "arborio rice", "basmati": "basmati rice", "groundnut": "peanut", "groundnut oil": "peanut oil",
    "rapeseed oil": "canola oil", "corn oil": "vegetable oil", "lemon zest": "lemon", "lemon juice": "lemon", "lime juice": "lime", "orange zest": "orange",
    "orange juice": "orange", "garlic cloves": "garlic", "clove of garlic": "garlic", "red onions": "red onion", "sultanas": "raisin",
    "runner beans": "green bean", "puy lentils": "lentil", "panko breadcrumbs": "panko", "maple syrup pure": "maple syrup", "golden syrup": "syrup",
    "vinegar white wine": "white wine vinegar", "balsamic": "balsamic vinegar", "cider vinegar": "apple cider vinegar",
}
# Names that count only as written, as their singular is another thing.
EXACT = {
    "peppers": "bell pepper", "bell peppers": "bell pepper", "red pepper": "bell pepper", "red peppers": "bell pepper", "green pepper": "bell pepper",
    "green peppers": "bell pepper", "yellow pepper": "bell pepper", "yellow peppers": "bell pepper", "romano pepper": "bell pepper",
    "romano peppers": "bell pepper",
}
# Grams that a cup holds.
GRAMS_A_CUP = {
    "flour": 125, "bread flour": 130, "self-rising flour": 125, "almond flour": 96, "cornstarch": 120, "cocoa": 100, "semolina": 167, "sugar": 200,
    "brown sugar": 220, "powdered sugar": 120, "honey": 340, "maple syrup": 322, "syrup": 328, "molasses": 337, "butter": 227, "ghee": 205, "rice": 185,
    "basmati rice": 185, "arborio rice": 200, "brown rice": 190, "jasmine rice": 185, "wild rice": 160, "quinoa": 170, "couscous": 173, "bulgur": 140,
    "barley": 200, "farro": 200, "polenta": 157, "cornmeal": 157, "oat": 90, "oatmeal": 90, "lentil": 192, "red lentil": 192, "chickpea": 164,
    "black bean": 172, "kidney bean": 177, "cannellini bean": 177, "butter bean": 170, "pea": 145, "breadcrumb": 108, "panko": 60, "almond": 143,
    "walnut": 117, "pecan": 109, "cashew": 137, "pistachio": 123, "hazelnut": 135, "peanut": 146, "pine nut": 135, "macadamia": 134, "sesame seed": 144,
    "sunflower seed": 140, "pumpkin seed": 129, "chocolate chip": 170, "dark chocolate": 170, "chocolate": 170, "raisin": 145, "currant": 144, "date": 147,
    "coconut": 93, "parmesan": 90, "cheddar": 113, "mozzarella": 112, "feta": 150, "cheese": 113, "ricotta": 246, "salt": 273, "yogurt": 245,
    "greek yogurt": 245, "sour cream": 230, "cream cheese": 232, "mayonnaise": 220, "peanut butter": 258, "tahini": 240, "tomato puree": 262,
    "canned tomato": 240, "olive": 135, "caper": 151, "mushroom": 70, "spinach": 30, "kale": 67, "onion": 160, "carrot": 128, "potato": 150, "corn": 154,
    "green bean": 110, "broccoli": 91,
}


def names() -> list[str]:
    """Every name of an ingredient once, by group."""
    return list(dict.fromkeys(n for group in GROUPS.values() for n in group))


def noise() -> list[str]:
    """Words that leave an ingredient what it is: descriptions, small words and units, unless a unit is a name as well."""
    spellings = {s + dot for own in UNITS.values() for s in own for dot in ("", ".")}
    return sorted({*DESCRIPTORS, *SMALL, *(spellings - set(names()))})


def frame(spark: SparkSession) -> DataFrame:
    """Rows (kind, key, target) that names.canonical and operators.lines join: 'exact' and 'synonym' map a phrase to a
    name, 'noun' is a name, 'noise' a word that is left out, 'staple' a name that is in every kitchen, 'grams' a name and
    what a cup of it weighs."""
    rows = [("exact", k, v) for k, v in EXACT.items()] + [("synonym", k, v) for k, v in SYNONYMS.items()]
    rows += [("noun", n, None) for n in names()] + [("noise", n, None) for n in noise()] + [("staple", n, None) for n in STAPLES]
    rows += [("grams", n, str(g)) for n, g in GRAMS_A_CUP.items()]
    return spark.createDataFrame(rows, "kind string, key string, target string").select("kind", F.lower("key").alias("key"), "target")
