"""The assembled search on a small star: stated times, strict diets, titles, favourites, facets and editions."""

import pytest

from galley.operators import find, match
from galley.sources.tables import Star

SOURCES = ["label", "labels-summed", "edited", "method", "estimate", None]


@pytest.fixture(scope="module")
def star(spark):
    recipes = [(i, 1 + i % 2, ["Lemon Tart", "lemon tart!", "Cream Soup"][i % 3], "Sweet lemon", 10 + i, SOURCES[i % 6], False, 0.5, i % 2) for i in range(12)]
    frame = spark.createDataFrame(recipes, "id long, book_id long, title string, section string, minutes int, time_source string, long_wait boolean, confidence double, n_unknown long")
    books = spark.createDataFrame([(1, "Ann", "A"), (2, "Bo", "B")], "id long, author string, title string")
    parts = spark.createDataFrame([(1, "extra fine dark brown sugar", False), (2, "lemon", False), (3, "salt", True)], "id long, canonical string, is_staple boolean")
    links = [(i, 1 + i % 2, 1, 1.0) for i in range(12)] + [(i, 3, 2, 1.0) for i in range(12)]
    tags = [(i, "diet", "vegan") for i in range(0, 12, 2)] + [(i, "diet", "vegetarian") for i in range(0, 12, 4)] + [(i, "allergen", "nuts") for i in range(0, 12, 3)] + [(i, "meal", "lunch") for i in range(6)]
    return Star(
        frame, books, parts, spark.createDataFrame(links, "recipe_id long, ingredient_id long, position int, quantity double"), spark.createDataFrame(tags, "recipe_id long, kind string, value string")
    )


def ids(frame):
    return {r.id for r in frame.collect()}


def test_only_stated_times(star):
    assert ids(find.find(star, find.Search(stated_only=True))) == {i for i in range(12) if i % 6 < 3}


def test_strict_needs_a_diet(star):
    assert len(ids(find.find(star, find.Search(strict=True)))) == 12
    assert ids(find.find(star, find.Search(strict=True, free_from=["nuts"]))) == {i for i in range(12) if i % 3 and not i % 2}
    assert ids(find.find(star, find.Search(diets=["vegan", "vegetarian"]))) == {0, 4, 8}


def test_titles_and_favourites(star, spark):
    assert len(ids(find.find(star, find.Search(words=["lem"])))) == 12
    assert ids(find.find(star, find.Search(title_words=["lem"]))) == {i for i in range(12) if i % 3 < 2}
    assert ids(find.find(star, find.Search(title_words=["lem"]), spark.createDataFrame([(2,), (3,)], "id long"))) == {3}


def test_facets_leave_out_their_own_choice(star):
    s = find.Search(diets=["vegan"], free_from=["nuts"], tags={"meal": ["lunch"]}, strict=True)
    found = {(r.kind, r.value): r.n for r in find.facets(star, s).collect()}
    known = {i for i in range(12) if i % 2 == 0}  # strict, beside a diet
    lunch, vegan, free = set(range(6)), {i for i in range(12) if i % 2 == 0}, {i for i in range(12) if i % 3}
    assert found == {("diet", "vegan"): len(known & lunch & free & vegan), ("diet", "vegetarian"): len({i for i in known & lunch & free if i % 4 == 0}),
                     ("meal", "lunch"): len(known & lunch & free & vegan), ("allergen", "nuts"): len(known & lunch & vegan - free)}
    only = {(r.kind, r.value): r.n for r in find.facets(star, find.Search(free_from=["nuts"], strict=True)).collect()}
    assert only[("allergen", "nuts")] == 4 and only[("meal", "lunch")] == len({i for i in range(6) if i % 3 and i % 2 == 0})


def test_one_row_a_dish_in_the_first_ones_place(star, spark):
    page = [r.id for r in find.find(star, find.Search(order="quickest", one_edition=True), saved=spark.createDataFrame([(9,), (7,), (10,)], "id long")).collect()]
    # Dishes: title (lemon tart in two spellings, cream soup) and ingredient by even or odd ids; first places 0, 1, 2, 5.
    assert page == [10, 7, 2, 5]
    assert [r.id for r in find.find(star, find.Search(order="quickest", one_edition=True)).collect()] == [0, 1, 2, 5]


def test_names_of_five_words_in_batches(star, spark):
    pantry = spark.createDataFrame([("p", "extra fine dark brown sugar"), ("q", "LEMON "), ("q", None)], "pantry string, name string")
    got = {(r.pantry, r.recipe_id) for r in match.matched_many(star, pantry).collect()}
    assert got == {("p" if i % 2 == 0 else "q", i) for i in range(12)}
    assert {r.recipe_id for r in match.matched(star, ["extra fine dark brown sugar"]).collect()} == {i for i in range(12) if i % 2 == 0}
