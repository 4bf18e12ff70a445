"""The DOM, section splitting and zones on small documents."""

import pytest

from potluck.operators import sections, zones
from potluck.operators.ingredients import from_headed_lines, from_runs, from_text, legacy_ingredients
from potluck.operators.instructions import after_ingredients, best_paragraph, by_class, by_prefix, by_verb_runs, is_stop, legacy_instructions
from potluck.sources.dom import clean_lines, list_items, parse

RECIPE = """<h2>Grilled Turkey</h2><h3>Ingredients</h3><ul class=a><li>2 lbs turkey breasts</li><li>1 tablespoon peanut oil</li>
<li>1 tsp salt</li></ul><h3 class=a>Instructions</h3><ol class=a><li>Preheat the grill to high heat.</li><li>Season the turkeys with salt.</li>
<li>Grill for 6 minutes on each side.</li><li>Let rest and serve.</li></ol><div><p>Cook time: 15 minutes</p><p class=a>Prep time: 10 minutes</p><p>Serves 4</p></div>"""


def test_lenient_parsing():
    root = parse("<p><b>one<br>two<p>three<ul><li>a<li>b <i>c</i></ul><script>x</script><style>y</style>end")
    assert [n.glued(" ") for n in root.find("p")] == ["one two", "three"]
    assert list_items(root.find("ul")[0]) == ["a", "b c"]
    assert "x" not in root.raw() and clean_lines(root).endswith("end")


@pytest.mark.parametrize("markup", [None, "", "</p></div>", "<div", "<p>&amp;&#233;<b>", b"\xff\xfe<p>x"])
def test_odd_markup_does_not_break(markup):
    assert clean_lines(parse(markup)) is not None


def test_intervals_and_siblings():
    root = parse("<div id=a><p>x</p><section><p>y</p></section></div><p>z</p>")
    a, s = root.find("div")[0], root.find("section")[0]
    assert s.inside(a) and not a.inside(s) and a.next().glued() == "z" and s.up("div") is a


def test_two_texts():
    p = parse("<p>1 <b>cup</b> of <i>tea</i></p>").find("p")[0]
    assert p.glued() == "1cupoftea" and p.glued("\n") == "1\ncup\nof\ntea"


def test_section_after_header():
    root = parse("<h3>Method</h3><p>Heat.</p><ul><li>a</li></ul><p>Stir.</p><h4>Next</h4><p>no</p>")
    assert sections.section_after_header(root, ["method"]) == "Heat.\n\na\n\nStir."
    assert sections.section_after_header(parse("<h3>Method</h3><ol><li>a</li><li>b</li></ol>"), ["method"]) == "- a\n- b"
    assert sections.section_after_header(root, ["sauce"]) is None


@pytest.mark.parametrize(("levels", "level"), [([2, 2, 2], 2), ([3, 3, 3, 2], 3), ([1, 1, 1, 2, 2], 1), ([2, 3, 3], 3), ([5, 5, 5], 5), ([4, 4, 4, 1, 1, 1], 4)])
def test_split_level(levels, level):
    assert sections.split_level(levels) == level


def test_split_by_headers():
    markup = "".join(f"<h2>{t}</h2><p>text of {t}</p>" for t in ("One", "Two", "Three", "12", "ab"))
    assert [t for t, _ in sections.split_by_headers(parse(markup))] == ["One", "Two", "Three"]
    two = sections.split_by_headers(parse("<h2>Only</h2><p>x</p>"))  # no h3: all headers are used
    assert [(t, clean_lines(r)) for t, r in two] == [("Only", "Only\nx")]


def test_sample_page_splits_at_its_three_subheads():
    parts = sections.split_document(parse(RECIPE))
    assert [t for t, _ in parts] == ["Ingredients", "Instructions"]
    assert len(clean_lines(parts[0][1])) < 100


def test_section_tags_nest_and_parts_are_skipped():
    inner = "<section aria-label='Inner'>" + "y" * 120 + "</section>"
    root = parse(f"<section epub:type='part'><section><h2>Outer dish</h2>{'x' * 120}{inner}</section></section>")
    assert [t for t, _ in sections.split_document(root)] == ["Outer dish", "Inner"]


def test_title_cascade():
    t = lambda markup: sections.title_from_content(parse(markup))
    assert t("<section title='Named one'><b>Bold title here</b></section>") == "Named one"
    assert t("<b>Serves four people</b><strong>Strong title</strong>") == "Strong title"
    assert t("<p>Short first one</p><p>" + "long " * 10 + "</p>") == "Short first one"
    assert t("<p>2 cups of flour mix</p><p>A line of text</p>") == "A line of text"
    assert t("<p>x</p>") is None
    assert sections.clean_title(" {x}Cake [link](url) ") == "Cake"


def zone(markup):
    return [(z.method, z.confidence, z.node.tag) for z in zones.ingredient_zones(parse(markup))]


def test_ingredient_zones():
    assert zone("<p itemprop='recipeIngredient'>x</p>") == [("schema_org", 0.95, "p")]
    assert zone("<div itemtype='http://schema.org/Recipe'><ul class='items'></ul></div>") == [("schema_org_context", 0.92, "ul")]
    assert zone("<div class='ingredients'></div><div class='my-ingredients'></div>") == [("css_class", 0.9, "div"), ("css_class", 0.85, "div")]
    assert zone("<p class='heading' id='Shopping'></p>") == [("id_attribute", 0.85, "p")]
    assert zone("<h4>Ingredients</h4><p>x</p>") == [("header_based", 0.75, "p")]
    assert zone("<ul><li>1 cup a</li><li>b</li></ul>") == [("list_based", 0.75, "ul")]
    assert zone("<ul><li>1 cup a</li><li>b</li><li>c</li></ul>") == [("list_based", 0.70, "ul")]
    assert zone("<div>" + "<p class='ing'>x</p>" * 3 + "</div>") == [("paragraph_class", 0.75, "div")]
    assert zone("<p class='ing'>x</p>" * 2) == []
    assert zone("<ul></ul><ol></ol>") == [("position_heuristic", 0.65, "ul")]
    # the same node found twice counts once, with the greater confidence
    assert zone("<h2>Ingredients</h2><ul class='ingredients'><li>1 cup a</li><li>2 cups b</li></ul>") == [("css_class", 0.9, "ul")]


def test_legacy_zones():
    found = zones.legacy_ingredient_zones(parse("<h2>For the dough</h2><ul><li>x</li></ul><div class='itemized'></div><p id='my-list'></p>"))
    assert [n.tag for n in found] == ["div", "p", "ul"]


def test_instruction_zones():
    got = lambda m: [(z.method, z.confidence, z.node.tag) for z in zones.instruction_zones(parse(m))]
    long = "x" * 41
    assert got("<p class='noindent'>x</p>") == [("css_class", 0.9, "p")]
    assert got(f"<h3>Directions</h3><p>{long}</p><p>short</p><h3>x</h3><p>{long}</p>") == [("header", 0.85, "p")]
    assert got(f"<p>For the sauce</p><p>{long}</p>") == [("post_ingredients", 0.75, "p")]
    assert got("<ol><li>a</li><li>b</li></ol><ol><li>a</li></ol>") == [("numbered_list", 0.8, "ol")]


def test_metadata_zones():
    got = lambda m: [(z.method, z.confidence, z.hints) for z in zones.metadata_zones(parse(m))]
    assert got("<section><p><i itemprop='prepTime'>5</i></p></section>") == [("schema_org", 0.95, ["prep_time"])]
    assert got("<p class='yield-info'>x</p>") == [("css_class", 0.9, ["servings"])]
    assert got("<h3>At a glance</h3><p>x</p>") == [("header", 0.85, [])]
    assert got("<dl><dt>Serves</dt><dd>4</dd></dl>") == [("definition_list", 0.8, ["servings"])]
    assert got("<dl></dl><dl>" + "<dt>x</dt>" * 11 + "</dl>") == []
    assert got("<ul><li>a: 1</li><li>b</li></ul>") == []  # exactly half have a colon
    assert got("<ul><li>a: 1</li></ul>") == [("list_structure", 0.75, [])]
    assert [z[0] for z in got("<p>Serves 4</p>" * 5)] == ["early_position"] * 3
    # what lies inside a kept zone is dropped
    assert got("<div class='meta'><p class='time'>x</p></div>") == [("css_class", 0.9, [])]


def test_ingredient_lines():
    text = ["For the dough", "2 cups flour", "not one", "", "1 tsp salt", "Mix it all together now", "3 cups water", "For the top", "4 large eggs"]
    assert from_headed_lines(text) == "For the dough\n- 2 cups flour\n- 1 tsp salt\n\nFor the top\n- 4 large eggs"
    assert from_headed_lines(["2 cups flour"]) is None
    assert from_runs(["1 cup a", "x", "1 cup b", "2 cups c", "1.", "9 cups z"]) == "- 1 cup b\n- 2 cups c"
    assert from_runs(["Serves 4", "1 cup a", "divided", "salt and pepper", "to taste"]) == "- 1 cup a\n- salt and pepper\n- to taste"
    assert from_runs(["1 cup a", "x", "1 cup b"]) is None
    assert from_text("") is None


def test_legacy_ingredients_order():
    assert legacy_ingredients(parse("<ul><li>1 cup a</li><li>2 cups b</li></ul>"), "") == "- 1 cup a\n- 2 cups b"
    paragraphs = "".join(f"<p class='ing'>thing {i}</p>" for i in range(3))
    assert legacy_ingredients(parse("<p class='ing'>For the dough</p>" + paragraphs), "") == "- thing 0\n- thing 1\n- thing 2"
    run = "".join(f"<p>{i} cups of flour</p>" for i in range(1, 4))
    assert legacy_ingredients(parse(run), "") == "- 1 cups of flour\n- 2 cups of flour\n- 3 cups of flour"
    assert legacy_ingredients(parse("<p>x</p>"), "x") is None


def test_instruction_strategies():
    step = "Heat the oil and stir the onions until they are soft."
    assert by_class(parse(f"<p class='method'>{step}</p><p class='step2'>{step}</p>")) == f"{step}\n\n{step}"
    assert by_prefix(parse(f"<p>To make the sauce: {step}</p>")) == f"To make the sauce: {step}"
    assert by_verb_runs(parse(f"<p>{step}</p><p>{'Now wait a while until it is done well.' * 1 + ' ' * 5 + '........'}</p><p>{step}</p>")) is not None
    assert after_ingredients(parse(f"<h3>For the sauce</h3><p>{step}</p><p>{step}</p>")) == f"{step}\n\n{step}"
    assert after_ingredients(parse(f"<p>{step}</p><p>{step}</p>")) is None
    one, more = "Cook, stir and serve it. " * 5, "Cook, stir, add and serve it. " * 5
    assert best_paragraph(parse(f"<p>{one}</p><p>{more}</p><p>{more}</p>")) == more.strip()
    assert is_stop("Notes: keep cold") and not is_stop("Keep the notes")


def test_whole_sample_as_one_section():
    root = parse(RECIPE)
    assert zones.ingredient_zones(root)[0].node.glued("\n") == "2 lbs turkey breasts\n1 tablespoon peanut oil\n1 tsp salt"
    assert legacy_instructions(root).startswith("- Preheat the grill")


def test_a_section_takes_all_siblings_after_its_header():
    page = "<h2>A long section</h2>" + "".join(f"<p>line {i}</p>" for i in range(1500)) + "<h3>Within</h3><h2>Second one</h2><p>x</p><h2>Third one</h2><p>y</p>"
    found = sections.split_by_headers(parse(page))
    assert [t for t, _ in found] == ["A long section", "Second one", "Third one"]
    assert len(clean_lines(found[0][1]).split("\n")) == 1502 and clean_lines(found[1][1]) == "Second one\nx"


def test_an_entity_that_breaks_off_is_text():
    assert clean_lines(parse("<h1>a &amp;&amp</h1><p>x &lt; y &ltz &nosuch; &#38; <a href='?a=1&copy=2'>l</a>")) == "a &&amp\nx < y &ltz &nosuch; &\nl"
    assert parse("<a href='?a=1&copy=2&amp;b'>l</a>").find("a")[0].attrs["href"] == "?a=1&copy=2&b"
