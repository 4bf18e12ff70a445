"""Pages of every shape the recipe operators tell apart, each with what has to come out of it.

In markup and results {k} stands for a supplier's key and {name} for its name. The results are
spelled out by hand, so they share no word list, pattern or code with the operators.
"""

from __future__ import annotations

_STIR = "Heat the oil of {name} and stir the onions until they are soft and sweet."
_SAUCE = f"To make the sauce: {_STIR} Serve it."
_LONG = (
    "{name} needs care. Heat the pan, add the oil, stir the onions, season the beans and cook them slowly until they are done; "
    "then cover the pot and simmer for an hour."
)
_BEST = "Cook the beans of {name}, stir them now and then, add salt and serve them hot on the very best plates."
_REST = "Leave it alone for a while, it needs its peace now."
_TWICE = f"{_STIR}\n\n{_STIR}"
_POT = "Stir the pot of {name} until it is done and hot."

#: shape -> (markup, zones as (method, confidence, text) in their order)
INGREDIENT_ZONES = {
    "microdata": (
        "<div class='box'><span itemprop='recipeIngredient'>{k} cups flour</span><span itemprop='recipeIngredient'>{name}</span></div>",
        [("schema_org", 0.95, "{k} cups flour"), ("schema_org", 0.95, "{name}")],
    ),
    "microdata box": (
        "<div itemtype='http://schema.org/Recipe'><ul class='my-items'><li>{k} cups rice</li><li>{name}</li></ul></div>",
        [("schema_org_context", 0.92, "{k} cups rice\n{name}")],
    ),
    "classes": (
        "<div class='ingredients'>{k} eggs</div><section class='recipe-components'>{name}</section><div class='other'>x</div>",
        [("css_class", 0.9, "{k} eggs"), ("css_class", 0.85, "{name}")],
    ),
    "id": ("<p id='Shopping-{k}'>{name}</p><p id='other'>x</p>", [("id_attribute", 0.85, "{name}")]),
    "header and list": ("<h2>What you need</h2><ul><li>{name}</li><li>oil</li></ul>", [("header_based", 0.85, "{name}\noil")]),
    "header and block": (
        "<h4>Shopping list</h4><p>{name}</p><h3>Ingredients</h3><div>{k} onions</div><h5>Notes</h5><p>x</p>",
        [("header_based", 0.8, "{k} onions"), ("header_based", 0.75, "{name}")],
    ),
    "half measured": ("<ul><li>{k} g salt</li><li>{name}</li></ul>", [("list_based", 0.75, "{k} g salt\n{name}")]),
    "a third measured": ("<ol><li>{k} ml milk</li><li>{name}</li><li>salt</li></ol>", [("list_based", 0.7, "{k} ml milk\n{name}\nsalt")]),
    "a quarter measured": ("<ol><li>{k} ml milk</li><li>{name}</li><li>salt</li><li>oil</li></ol>", []),
    "paragraph classes": (
        "<article><p class='ing'>{k} eggs</p><p class='ingt'>milk</p><p class='x ing'>{name}</p><p>end</p></article>",
        [("paragraph_class", 0.75, "{k} eggs\nmilk\n{name}\nend")],
    ),
    "two paragraphs": ("<article><p class='ing'>{k} eggs</p><p class='ing'>{name}</p><p>end</p></article>", []),
    "two lists": ("<ul><li>{name}</li></ul><ol><li>more</li></ol>", [("position_heuristic", 0.65, "{name}")]),
    "one node found often": (
        "<h2>Ingredients</h2><ul class='ingredients' id='ingredients'><li>{k} cups oats</li><li>{name}</li></ul>",
        [("css_class", 0.9, "{k} cups oats\n{name}")],
    ),
    "surest first": (
        "<div class='groceries'>{k} pears</div><span itemprop='recipeIngredient'>{name}</span>",
        [("schema_org", 0.95, "{name}"), ("css_class", 0.9, "{k} pears")],
    ),
    "none": ("<p>{name}</p>", []),
}

LEGACY_ZONES = {
    "class and id": ("<div class='x-ingredient'>{k} a</div><p id='my-list'>{name}</p>", ["{k} a", "{name}"]),
    "patterns in turn": ("<p id='item-{k}'>{name}</p><div class='ingredients'>b</div>", ["b", "{name}"]),
    "after a header": ("<h2>For the dough</h2><ul><li>{name}</li></ul>", ["{name}"]),
    "list some way after": ("<h2>Ingredients of {k}</h2><p>{name}</p><ol><li>x</li></ol>", ["{name}", "x"]),
    "list of another header": ("<h2>Ingredients</h2><p>{name}</p><h3>Method</h3><ol><li>x</li></ol>", ["{name}"]),
    "none": ("<p>{name}</p>", []),
}

INSTRUCTION_ZONES = {
    "classes": ("<div class='method'>{k} parts</div><p class='noindent'>{name}</p>", [("css_class", 0.9, "{k} parts"), ("css_class", 0.9, "{name}")]),
    "header": (
        f"<h2>Directions</h2><p>{_POT}</p><p>short</p><ol><li>Then again: {_POT}</li></ol><h3>Next</h3><p>{_POT}</p>",
        [("header", 0.85, _POT), ("header", 0.85, f"Then again: {_POT}")],
    ),
    "after ingredients": (
        f"<p>For the sauce</p><p>{_POT}</p><div>tiny</div><section>Then again: {_POT}</section>",
        [("post_ingredients", 0.75, _POT), ("post_ingredients", 0.75, f"Then again: {_POT}")],
    ),
    "eleventh after": (f"<h2>Ingredients</h2>{'<b>x</b>' * 10}<p>{_POT}</p>", []),
    "tenth after": (f"<h2>Ingredients</h2>{'<b>x</b>' * 9}<p>{_POT}</p>", [("post_ingredients", 0.75, _POT)]),
    "numbered": ("<ol><li>{name}</li><li>b</li></ol><ol><li>only</li></ol>", [("numbered_list", 0.8, "{name}\nb")]),
    "the surer of two": (f"<h2>Method</h2><ol><li>{_POT}</li><li>b</li></ol>", [("header", 0.85, f"{_POT}\nb")]),
    "none": ("<p>{name}</p>", []),
}

#: zones as (method, confidence, hints, text)
METADATA_ZONES = {
    "microdata": ("<section><p><span itemprop='prepTime'>{k} min</span></p></section>", [("schema_org", 0.95, "prep_time", "{k} min")]),
    "class": ("<p class='yield-info prep-box'>{name}</p>", [("css_class", 0.9, "servings,prep_time", "{name}")]),
    "header": ("<h3>Recipe info</h3><dl><dt>Serves</dt><dd>{k}</dd></dl>", [("header", 0.85, "", "Serves\n{k}")]),
    "after the header's box": ("<div><h4>Stats</h4></div><p>{name}</p>", [("header", 0.85, "", "{name}")]),
    "terms": (
        "<dl><dt>Prep</dt><dd>{k} min</dd><dt>Cook method</dt><dd>oven</dd></dl>",
        [("definition_list", 0.8, "prep_time,cook_time,cooking_method", "Prep\n{k} min\nCook method\noven")],
    ),
    "eleven terms": (f"<dl>{'<dt>Prep</dt>' * 11}</dl>", []),
    "colons": ("<ul><li>Level: {k}</li><li>Kind: {name}</li><li>plain</li></ul>", [("list_structure", 0.75, "", "Level: {k}\nKind: {name}\nplain")]),
    "half with colons": ("<ul><li>Level: {k}</li><li>{name}</li></ul>", []),
    "first three": (
        "<p>Serves {k}</p><p>Makes {name}</p><p>x</p><p>Cook it</p><p>Yield {k}</p>",
        [("early_position", 0.7, "", "Serves {k}"), ("early_position", 0.7, "", "Makes {name}"), ("early_position", 0.7, "", "Cook it")],
    ),
    "one inside another": ("<div class='meta'><p class='time'>{k} h</p></div>", [("css_class", 0.9, "", "{k} h")]),
    "one around another": ("<div class='meta'><section><i itemprop='totalTime'>{k} h</i></section></div>", [("css_class", 0.9, "", "{k} h")]),
    "none": ("<p>{name}</p>", []),
}

#: shape -> (markup, strategy -> text); strategies that find nothing are left out
INGREDIENT_STRATEGIES = {
    "header": (
        "<h3>Ingredients</h3><ul><li>{k} cups flour</li><li>a pinch of salt and pepper</li><li>{name} brand butter</li></ul>",
        {"headed_lines": "Ingredients\n- {k} cups flour", "cascade": "- {k} cups flour\n- a pinch of salt and pepper\n- {name} brand butter"},
    ),
    "short text after header": (
        "<h3>Ingredients</h3><p>{k} cups rice</p><p>{name}</p>",
        {"headed_lines": "Ingredients\n- {k} cups rice", "cascade": "Ingredients\n- {k} cups rice"},
    ),
    "list": (
        "<ul><li>{k} cups flour</li><li>2 large eggs</li></ul>",
        {n: "- {k} cups flour\n- 2 large eggs" for n in ("lists", "line_runs", "cascade")},
    ),
    "paragraph classes": (
        "<p class='ing'>For the dough</p><p class='ing'>{name} flour</p><p class='ingt'>salt</p><p class='recipe-ingredient'>water</p>",
        {n: "- {name} flour\n- salt\n- water" for n in ("paragraph_classes", "cascade")},
    ),
    "paragraphs": (
        "<p>{k} cups of flour</p><p>2 tablespoons sugar</p><p>short</p><p>{k} large eggs</p><p>Then nothing for long</p>",
        {"paragraph_runs": "- {k} cups of flour\n- 2 tablespoons sugar\n- {k} large eggs", "line_runs": "- {k} cups of flour\n- 2 tablespoons sugar", "cascade": "- {k} cups of flour\n- 2 tablespoons sugar\n- {k} large eggs"},
    ),
    "headed lines": (
        "<div>For the top<br>{k} cups cream<br>3 large eggs<br>Whisk it all together<br>9 cups more</div>",
        {"headed_lines": "For the top\n- {k} cups cream\n- 3 large eggs", "line_runs": "- {k} cups cream\n- 3 large eggs", "cascade": "For the top\n- {k} cups cream\n- 3 large eggs"},
    ),
    "lines after servings": (
        "<div>Serves {k}<br>{k} cups cream<br>{name}<br>salt and pepper<br>to taste</div>",
        {n: "- {k} cups cream\n- salt and pepper\n- to taste" for n in ("line_runs", "cascade")},
    ),
    "longest run": (
        "<div>{k} cups cream<br>2 cups milk<br>{name}<br>1 cup tea<br>3 large eggs<br>4 cups rice<br>1.<br>9 cups more<br>8 cups more</div>",
        {n: "- 1 cup tea\n- 3 large eggs\n- 4 cups rice" for n in ("line_runs", "cascade")},
    ),
    "none": ("<p>{name}</p>", {}),
}

INSTRUCTION_STRATEGIES = {
    "class": (f"<p class='method'>{_STIR}</p><p class='step2'>{_STIR}</p>", {n: _TWICE for n in ("by_class", "by_verb_runs", "cascade")}),
    "header": (f"<h3>Directions</h3><p>{_STIR}</p><p>{_STIR}</p>", {n: _TWICE for n in ("by_header", "by_verb_runs", "cascade")}),
    "prefix": (f"<p>{_SAUCE}</p><p>{{name}}</p>", {"by_header": "{name}", "by_prefix": _SAUCE, "best_paragraph": _SAUCE, "cascade": _SAUCE}),
    "long narrative": (f"<p>{_LONG}</p>", {n: _LONG for n in ("by_long_narrative", "best_paragraph", "cascade")}),
    "after ingredients": (f"<h3>For the sauce</h3><p>{_STIR}</p><p>{_STIR}</p>", {n: _TWICE for n in ("after_ingredients", "by_verb_runs", "cascade")}),
    "list": (
        "<ol><li>Heat the oil of {name}.</li><li>Stir in the onions and cook until soft, then season well.</li><li>Serve with bread.</li></ol>",
        {n: "1. Heat the oil of {name}.\n\n2. Stir in the onions and cook until soft, then season well.\n\n3. Serve with bread." for n in ("from_lists", "cascade")},
    ),
    "verb runs": (f"<p>{_STIR}</p><p>{_REST}</p><p>{_STIR}</p>", {n: f"{_STIR}\n\n{_REST}\n\n{_STIR}" for n in ("by_verb_runs", "cascade")}),
    "best paragraph": (f"<p>{_BEST}</p>", {n: _BEST for n in ("best_paragraph", "cascade")}),
    "none": ("<p>{name}</p>", {}),
}

_WORDS = " ".join(["bread"] * 20)
#: shape -> (markup, sections as (title, text))
SPLITS = {
    "section tags": (
        f"<section epub:type='part'><section><h3>Cake of {{name}}</h3><p>{_WORDS}</p></section><section aria-label='Label {{k}}'><p>{_WORDS}</p></section><section><p>short</p></section></section>",
        [("Cake of {name}", f"Cake of {{name}}\n{_WORDS}"), ("Label {k}", _WORDS)],
    ),
    "section within a section": (
        f"<section><h2>Outer {{name}}</h2><p>{_WORDS}</p><section><h2>12</h2><h3>Inner {{k}}</h3><p>{_WORDS}</p></section></section>",
        [("Outer {name}", f"Outer {{name}}\n{_WORDS}\n12\nInner {{k}}\n{_WORDS}"), ("Inner {k}", f"12\nInner {{k}}\n{_WORDS}")],
    ),
    "no title": (f"<section><p>{_WORDS}</p></section>", [("Untitled", _WORDS)]),
    "three of level two": (
        "<h1>Book</h1><h2>First {name}</h2><p>a</p><h3>sub</h3><p>b</p><h2>Second</h2><p>c</p><h2>44</h2><p>d</p><h2>Third {x}</h2>",
        [("First {name}", "First {name}\na\nsub\nb"), ("Second", "Second\nc"), ("Third", "Third {x}")],
    ),
    "three of level one": (
        "<h1>One</h1><p>a</p><h1>Two</h1><h3>x</h3><h1>Six [link](y)</h1><p>{name}</p>",
        [("One", "One\na"), ("Two", "Two\nx"), ("Six", "Six [link](y)\n{name}")],
    ),
    "level three by default": ("<h2>Top</h2><h3>Part {k}</h3><p>a</p><h3>Part two</h3><p>b</p>", [("Part {k}", "Part {k}\na"), ("Part two", "Part two\nb")]),
    "few headers": ("<h2>Only one here</h2><p>{name}</p>", [("Only one here", "Only one here\n{name}")]),
    "title of the section": ("<section title='Named {name}'><p>a</p></section>", [("Named {name}", "a")]),
    "bold title": ("<p>x</p><b>Serves {k} or more</b><b>Bread of {name}</b><p>y</p>", [("Bread of {name}", "x\nServes {k} or more\nBread of {name}\ny")]),
    "short paragraph": (f"<p>Bread of {{name}}</p><p>{_WORDS}</p>", [("Bread of {name}", f"Bread of {{name}}\n{_WORDS}")]),
    "first fitting line": ("<p>1 a line with a number</p><div>Bread of {name}</div>", [("Bread of {name}", "1 a line with a number\nBread of {name}")]),
    "nothing fits": ("<p>{k}</p>", [("Untitled", "{k}")]),
}

_NARRATIVE = "My aunt Ada told us about the long summers of {name} by the sea, and we would listen to her until dark."
_LIST = "<li>{k} cups flour</li><li>2 tablespoons sugar</li><li>1 tsp salt</li><li>3 large eggs of {name}</li>"
_LISTED = "{k} cups flour\n2 tablespoons sugar\n1 tsp salt\n3 large eggs of {name}"
_BULLETS = "\n".join("- " + x for x in _LISTED.split("\n"))
#: shape -> (markup, nothing, (strategy, confidence of the zone or 0, number of zones, text))
INGREDIENT_CHOICES = {
    "zone": (f"<ul class='ingredients'>{_LIST}</ul>", None, ("structural_zones css_class", 0.9, 1, _LISTED)),
    "two zones": (f"<h2>Ingredients</h2><ol>{_LIST}</ol><ul><li>{{k}} cups a</li><li>2 cups b</li></ul>", None, ("structural_zones header_based", 0.85, 2, _LISTED)),
    "poor zone": (f"<div class='items'>{_NARRATIVE}</div><ul>{_LIST}</ul>", None, ("original_with_patterns", 0.0, 2, _BULLETS)),
    "short zone": (f"<div class='items'>x</div><ul>{_LIST}</ul>", None, ("original_with_patterns", 0.0, 2, _BULLETS)),
    "no zone": (
        "<p>{k} cups of flour</p><p>2 tablespoons sugar</p><p>{k} large eggs</p><p>{name}</p>",
        None,
        ("original_with_patterns", 0.0, 0, "- {k} cups of flour\n- 2 tablespoons sugar\n- {k} large eggs"),
    ),
    "nothing": ("<p>{name}</p>", None, ("", 0.0, 0, "")),
}

_DO = "First heat the oil of {name}. Then stir the onions until soft and season them. Next add the beans and simmer for a while. Finally remove the pan and serve."
INSTRUCTION_CHOICES = {
    "zone": (f"<div class='method'>{_DO}</div>", None, ("structural_css_class", 0.9, 1, _DO)),
    "better of two": (f"<p class='noindent'>{_NARRATIVE}</p><h2>Directions</h2><p>{_DO}</p>", None, ("structural_header", 0.85, 2, _DO)),
    "no zone": (f"<p>{_LONG}</p>", None, ("original_with_patterns", 0.0, 0, _LONG)),
    "nothing": ("<p>{name}</p>", None, ("", 0.0, 0, "")),
}


def markup(shapes: dict) -> list[tuple[str, str]]:
    return [(name, page) for name, (page, _) in shapes.items()]


def _sql(value) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"{value}::DOUBLE" if isinstance(value, float) else str(value)


def expected(rows: list[tuple], columns: list[str], *filled: str) -> str:
    """SQL for the rows of every supplier; columns is the names of their values, of which text and those in filled have the stand-ins."""
    values = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)
    fill = lambda c: f"replace(replace(e.{c}, '{{k}}', CAST(s_suppkey AS VARCHAR)), '{{name}}', s_name) AS {c}"
    some = ", ".join(fill(c) if c == "text" or c in filled else f"e.{c}" for c in columns)
    return f"SELECT s_suppkey AS id, {some} FROM supplier CROSS JOIN (VALUES {values}) e({', '.join(columns)})"


def zones_sql(shapes: dict) -> str:
    return expected([(shape, i, *z) for shape, (_, zones) in shapes.items() for i, z in enumerate(zones)], ["shape", "ord", "method", "confidence", "text"])


def metadata_sql() -> str:
    return expected([(shape, i, *z) for shape, (_, zones) in METADATA_ZONES.items() for i, z in enumerate(zones)], ["shape", "ord", "method", "confidence", "hints", "text"])


def legacy_sql() -> str:
    return expected([(shape, i, t) for shape, (_, texts) in LEGACY_ZONES.items() for i, t in enumerate(texts)], ["shape", "ord", "text"])


def strategies_sql(shapes: dict) -> str:
    return expected([(shape, n, t) for shape, (_, found) in shapes.items() for n, t in found.items()], ["shape", "strategy", "text"])
