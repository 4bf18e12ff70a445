"""Scores, predicates and parsers against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from potluck.functions import metadata as m
from potluck.functions import scoring as s
from potluck.functions import validate as v
from potluck.functions.text import lines, strip, words


def values(spark, rows, *columns):
    """The columns' values over one string column x."""
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [tuple(r)[1:] for r in df.select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()]


X = F.col("x")


def test_strip_and_split(spark):
    got = values(spark, ["\t a b \n", "", None], strip(X), lines(X), words(X))
    assert got == [("a b", ["a b"], ["a", "b"]), ("", [], []), (None, None, None)]


def test_ingredient_points_cutoffs(spark):
    cases = {49: 3, 50: 6, 99: 6, 100: 9, 199: 9, 200: 12, 299: 12, 300: 15}
    got = values(spark, ["x" * n for n in cases], s.ingredient_points(X))
    assert [g[0] for g in got] == [p + 2 for p in cases.values()]  # one long line gives 2


def test_ingredient_points_parts(spark):
    numbered = "\n".join(f"{i}. item number" for i in range(1, 11))
    dashed = "\n".join(["- item number"] * 10)
    got = values(spark, [numbered, dashed, "1 cup", "½", "", None], s.ingredient_points(X))
    # dashes without a dot are no structured lines
    assert [g[0] for g in got] == [9 + 15 + 10, 9 + 10, 3 + 5, 3 + 5, 0, 0]


def test_instruction_points(spark):
    steps = "1. Heat it.\n2. Stir it.\n3. Serve!"
    got = values(spark, [steps, "x" * 500, "a.b.c.d.e.", None], s.instruction_points(X))
    assert [g[0] for g in got] == [3 + 12 + 3 + 5, 15, 3 + 5, 0]


def test_quality_of_the_sample_recipe(spark):
    row = spark.range(1).select(
        s.quality(
            F.lit("- 2 cups wheat\n- 1 cup honey\n- 3 eggs."[:37]),
            F.lit("1. Mix the flour.\n2. Add eggs.\n3. Bake for 30 min"[:48] + "."),
            *[F.lit(x) for x in ("4", "10", "20", "bake", "egg")],
        ).alias("q")
    )
    assert row.first()["q"] == (3 + 0 + 4 + 5) + (3 + 12 + 5 + 5) + 10  # three verbs, six full stops


def test_quality_penalties_and_range(spark):
    none = F.lit(None).cast("string")
    q = lambda a, b: spark.range(1).select(s.quality(a, b, *[none] * 5).alias("q")).first()["q"]
    assert q(none, none) == 0
    assert q(F.lit("x" * 500), none) == 0
    assert q(F.lit("1. 2 cups of it\n" * 60), F.lit("1. Heat, cook, mix, stir, add, place, bake, fry. Now!\n" * 60)) == 90


@pytest.mark.parametrize("score", ["ingredient_confidence", "instruction_confidence", "ingredient_linguistic", "instruction_linguistic", "metadata_linguistic", "legacy_linguistic", "legacy_ingredient_confidence"])
def test_scores_stay_in_range(spark, score):
    texts = [None, "", " ", "x" * 9, "x" * 10, "2 cups flour\n1 tsp salt\n3 large eggs, beaten", "heat " * 50, "Preheat oven to 350. Mix. Then bake until done.", "a\n" * 2000]
    got = [g[0] for g in values(spark, texts, getattr(s, score)(X))]
    assert got[:3] == [0.0, 0.0, 0.0] and all(0.0 <= g <= 1.0 for g in got)


def test_verb_density_cutoffs(spark):
    text = lambda verbs, total: " ".join(["heat"] * verbs + ["word"] * (total - verbs))
    got = values(spark, [text(4, 100), text(5, 100), text(10, 100), text(40, 100), text(60, 100), text(61, 100)], s.verb_density(X))
    # at exactly 60 the falling branch still holds
    assert [round(g[0], 6) for g in got] == [0.0, 0.0, 1.0, 1.0, 0.0, 0.3]


def test_paragraph_and_sentence_length(spark):
    got = values(spark, ["x" * n for n in (49, 50, 100, 500, 750, 1000, 1001)], s.paragraph_length(X))
    assert [g[0] for g in got] == [0.0, 0.0, 1.0, 1.0, 0.5, 0.0, 0.0]
    got = values(spark, ["x" * n for n in (19, 20, 30, 40, 150, 200, 250, 251)], s.sentence_structure(X))
    assert [round(g[0], 6) for g in got] == [0.0, 0.0, 0.5, 1.0, 1.0, 0.5, 0.0, 0.0]


def test_stop_score(spark):
    got = values(spark, ["tip: rest it", "rest it (tip)", "a note", "nothing"], s.stop_score(X))
    assert [g[0] for g in got] == [0.0, 0.5, 0.5, 1.0]
    assert values(spark, ["see the tips"], s.stop_score(X)) == [(0.0,)]  # "tips" is "tip" too


def test_field_confidence(spark):
    got = values(spark, ["Serves 4-6 people", "Prep time: 15 minutes", "xx"], s.field_confidence(X, "servings"), s.field_confidence(X, "time"), s.field_confidence(X, "colour"))
    assert [tuple(round(x, 6) for x in g) for g in got[:2]] == [(1.0, 0.1, 0.0), (0.3, 1.0, 0.0)]
    assert got[2] == (0.0, 0.0, 0.0)


def test_servings(spark):
    table = {"4": "4", "4-6": "4-6", "4 to 6": "4-6", "4 - 6": "4-6", "(pressure cooker):": None, "serves 12": "12", "": None, "about 2 (or 3) people": "2", None: None}
    assert [g[0] for g in values(spark, list(table), m.parse_servings(X))] == list(table.values())


def test_times(spark):
    table = {
        "1 hour 30 minutes": 90, "1.5 hours": 90, "30": 30, "-5 minutes": None, "- 5 minutes": None, "-1 hour": None, "invalid": None, "25 hours": None,
        "30-45 minutes": 45, "15 - 20 minutes": None, "24 hours": 1440, "1441": None, "0": None, "20 mins": 20, "1.99 hr": 119, None: None,
    }
    assert [g[0] for g in values(spark, list(table), m.parse_time(X))] == list(table.values())


def test_extract_metadata(spark):
    texts = {
        "Prep Time: 15 minutes": ("prep_time", "15"),
        "Preparation: 20 mins": ("prep_time", "20"),
        "Active Time: 30 minutes": ("prep_time", "30"),
        "Cook Time: 45 minutes": ("cook_time", "45"),
        "Cooking: 1 hour": ("cook_time", "60"),
        "Baking Time: 1 hour 15 minutes": ("cook_time", "75"),
        "Yields: 12": ("serves", "12"),
        "smoked and grilled": ("cooking_method", "smoke"),
        "lamb or beef": ("protein_type", "beef"),
    }
    got = values(spark, list(texts), m.extract_metadata(X, F.lit("")))
    assert [g[0][f] for g, (f, _) in zip(got, texts.values())] == [x for _, x in texts.values()]
    # a dot ends what the pattern takes, so no time is found
    assert values(spark, ["Prep time: 1.5 hours"], m.extract_metadata(X, F.lit("")))[0][0]["prep_time"] is None


def test_detected_metadata(spark):
    d = values(spark, ["Serves 4 to 6\nPrep time: 15 minutes\nGrilled chicken, easy"], m.detected_metadata(X, F.lit("")))[0][0]
    assert d["servings"]["value"] == "4"  # "4 to 6" is no range in this pattern
    assert d["prep_time"]["value"] == "15 minutes" and d["cook_time"] is None
    assert d["cooking_method"]["value"] == "grill" and d["protein_type"]["value"] == "chicken" and d["difficulty"]["value"] == "easy"


def test_validate_metadata(spark):
    row = spark.sql("SELECT map('serves', 'x', 'prep_time', '1 hour', 'cook_time', ' ', 'other', 'kept') AS f").select(m.validate_metadata(F.col("f")).alias("v")).first()
    assert row["v"] == {"prep_time": "60", "other": "kept"}


def test_sub_sections_and_titles(spark):
    subs = ["Equipment needed:", "Gear:Handheld smoker", "Prep time: 5", "serves 4", "For the sauce", "Sea salt", "Glaze", "the filling", "Tips:", "Chef's note:"]
    good = ["Glazed ham", "Beef with sauce", "Garnished salad", "Notes on beef stew with beans"]
    assert [g[0] for g in values(spark, subs + good, v.is_sub_section(X))] == [True] * len(subs) + [False] * len(good)
    items = {"2 cups flour": True, "¼ cup oil": True, "butter": True, "olive oil blend": True, "Olive oilcake": False, "Route 66 pie": True, "Braised short ribs of the old town inn, 2": False}
    assert [g[0] for g in values(spark, list(items), v.is_ingredient_title(X))] == list(items.values())


def test_toc_titles(spark):
    table = {"Chapter 3": False, "Part 1": False, "Introduction": False, "ab": False, "12": False, "taco": True, "Elevenchars": True, "Tenletters": False, None: False}
    assert [g[0] for g in values(spark, list(table), v.is_likely_recipe_title(X))] == list(table.values())


def test_valid_recipe(spark):
    text = "Ingredient list: 2 cups flour and 3 large eggs. Mix, stir and bake them. " * 4
    got = values(spark, [text, "too short"], v.is_valid_recipe(X, F.lit("Grandmother's bread")), v.is_valid_recipe(X, F.lit("Glossary")))
    assert got == [(True, False), (False, False)]
    # plurals of the key words don't count
    assert values(spark, ["ingredients and instructions"], v.recipe_points(X)) == [(0,)]


def test_line_predicates(spark):
    got = values(spark, ["2 cups flour", "Add 2 cups flour", "For the dough", "For the 2 cups flour", "x" * 101, "Salt and pepper", "Tips: rest"],
                 v.is_ingredient_line(X), v.is_instruction_line(X), v.is_ingredient_header(X), v.is_loose_ingredient(X), v.is_stop_line(X))
    assert [g[:3] for g in got] == [(True, False, False), (False, True, False), (False, False, True), (True, False, False), (False, True, False), (False, False, False), (False, False, False)]
    assert got[5][3] is True and got[6][4] is True
