"""EPUB files to recipes, end to end, on archives built here."""

import difflib
import json
import os
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from potluck.cli import parser
from potluck.cli import run as cli
from potluck.operators import abtest, analyze, quality
from potluck.operators.store import RecipeStore
from potluck.plans import pipeline
from potluck.plans.config import Components, Config, Extraction, LogLevel
from potluck.sources import epub
from potluck.sources.dom import parse
from potluck.streaming.ingest import ingest_folder

from .test_dom import RECIPE

DISH = """<section><h2>{title}</h2><p>Serves 6</p><p>Prep time: 20 minutes</p><ul class="ingredients"><li>2 cups flour</li><li>3 tablespoons sugar</li>
<li>1 tsp salt</li><li>3 large eggs</li></ul><ol><li>Preheat the oven and mix the flour with the sugar.</li><li>Stir in the eggs, then bake until golden.</li>
<li>Remove, let it cool and serve warm.</li></ol></section>"""
PAGES = {
    "front.xhtml": "<h1>Foreword</h1><p>" + "words " * 40 + "</p>",
    "one.xhtml": DISH.format(title="Golden honey cake"),
    "two.xhtml": "".join(f"<h2>Plain stew {i}</h2><p>Cook 2 cups of beans, stir them and add 3 cups water. Serve it. {'More of it. ' * 10}</p>" for i in range(3)),
    "bare.xhtml": "<p>" + "nothing here " * 20 + "</p>",
}
TOC = """<navPoint><navLabel><text>Sweets</text></navLabel><content src="front.xhtml"/>
<navPoint><navLabel><text>Golden honey cake</text></navLabel><content src="one.xhtml#top"/></navPoint>
<navPoint><navLabel><text>Chapter 3</text></navLabel><content src="x.xhtml"/></navPoint></navPoint>
<navPoint><navLabel><text>Plain stews of old</text></navLabel><content src="two.xhtml"/></navPoint>"""


def make_epub(path, title="The Book", author="An Author", pages=PAGES, toc=TOC):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(pages))
        dc = (f"<dc:title>{title}</dc:title>" if title else "") + (f"<dc:creator>{author}</dc:creator>" if author else "")
        opf = f"""<package xmlns="urn:opf" xmlns:dc="urn:dc"><metadata>{dc}</metadata><manifest>{items}<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>
<item id="pic" href="a.png" media-type="image/png"/></manifest><spine toc="ncx"/></package>"""
        z.writestr("OEBPS/content.opf", opf)
        z.writestr("OEBPS/toc.ncx", f'<ncx xmlns="urn:ncx"><navMap>{toc}</navMap></ncx>')
        z.writestr("OEBPS/a.png", b"png")
        for name, body in pages.items():
            z.writestr(f"OEBPS/{name}", f"<html xmlns='http://www.w3.org/1999/xhtml' xmlns:epub='urn:e'><body>{body}</body></html>")
    return str(path)


@pytest.fixture(scope="module")
def shelf(tmp_path_factory):
    d = tmp_path_factory.mktemp("shelf")
    make_epub(d / "book.epub")
    make_epub(d / "plain.epub", title="", author="", toc="")
    (d / "broken.epub").write_bytes((d / "book.epub").read_bytes()[:300])
    (d / "notes.txt").write_text("no book")
    return d


def test_documents_of_an_epub(spark, shelf):
    rows = epub.read_documents(epub.scan_files(spark, str(shelf / "book.epub"))).orderBy("item_ordinal").collect()
    assert [(r["item_name"], r["book"], r["author"], r["chapter"]) for r in rows] == [
        ("front.xhtml", "The Book", "An Author", "Sweets"),
        ("one.xhtml", "The Book", "An Author", "Unknown"),  # its only entry is nested and has a fragment
        ("two.xhtml", "The Book", "An Author", "Plain stews of old"),
        ("bare.xhtml", "The Book", "An Author", "Unknown"),
    ]


def test_defaults_and_errors(spark, shelf):
    rows = epub.read_documents(epub.scan_files(spark, str(shelf))).groupBy("book", "author").agg(F.count("content").alias("n"), F.max("error").alias("e")).collect()
    got = {(r["book"], r["author"]): (r["n"], r["e"] is None) for r in rows}
    assert got == {("The Book", "An Author"): (4, True), ("plain", "Unknown"): (4, True), ("broken", None): (0, False)}
    with pytest.raises(FileNotFoundError):
        epub.scan_files(spark, str(shelf / "absent.epub"))
    with pytest.raises(ValueError):
        pipeline.extract_recipes(spark, str(shelf / "broken.epub"))


def test_extract_recipes(spark, shelf):
    rows = {r["title"]: r for r in pipeline.extract_recipes(spark, str(shelf / "book.epub")).collect()}
    cake = rows["Golden honey cake"]
    assert cake["ingredients"] == "2 cups flour\n3 tablespoons sugar\n1 tsp salt\n3 large eggs"
    assert cake["instructions"].startswith("1. Preheat") and (cake["serves"], cake["prep_time"], cake["cook_time"], cake["cooking_method"]) == ("6", "20", None, "bake")
    assert cake["epub_section"] == "one.xhtml" and cake["tags"] == [] and "Golden" in cake["raw_content"]
    details = json.loads(cake["metadata"])["extraction"]["ingredients"]
    assert details["strategy"] == "structural_zones" and details["detection_method"] == "css_class" and details["combined_score"] >= 0.5
    assert 20 <= cake["quality_score"] <= 100 and "Foreword" not in rows


def test_threshold_is_monotone(spark, shelf):
    n = [pipeline.extract_recipes(spark, str(shelf / "book.epub"), Config.of(min_quality_score=m)).count() for m in (0, 20, 40, 101)]
    assert n == sorted(n, reverse=True) and n[-1] == 0


def test_legacy_mode_and_raw_content(spark, shelf):
    row = pipeline.extract_recipes(spark, str(shelf / "book.epub"), Config.of(use_pattern_extraction=False, include_raw_content=False)).where("title like 'Golden%'").first()
    assert row["ingredients"].startswith("- 2 cups flour\n- 3 tablespoons") and row["metadata"] is None and row["raw_content"] is None


def test_batch_isolates_bad_files(spark, shelf):
    recipes, files = pipeline.batch(spark, str(shelf))
    row = quality.batch_summary(files, recipes).first()
    assert (row["files_ok"], row["files_failed"]) == (2, 1) and row["recipes"] == recipes.count() > 0


def test_sample_page_as_one_section(spark):
    rows = spark.createDataFrame([("Grilled Turkey", "b", "a", RECIPE)], "title string, book string, author string, markup string")
    r = pipeline.extract_from_section(rows).first()
    assert (r["quality_score"], r["serves"], r["prep_time"], r["cook_time"], r["cooking_method"], r["protein_type"]) == (15 + 14 + 10, "4", "10", "15", "grill", "turkey")
    d = json.loads(r["metadata"])["extraction"]["ingredients"]
    assert (d["strategy"], d["detection_method"], d["zone_count"], d["structural_confidence"]) == ("structural_zones", "header_based", 1, 0.85)
    assert abs(d["confidence"] - 0.716) < 0.01 and abs(d["combined_score"] - 0.736) < 0.01
    # split as a document, neither part is a recipe
    page = spark.createDataFrame([("b", "a", "i", 0, "c", RECIPE)], "book string, author string, item_name string, item_ordinal int, chapter string, content string")
    assert pipeline.extract_from_documents(page).count() == 0


def test_instruction_zones_compete(spark):
    text = "Preheat the oven to 350. Mix the flour and then add the eggs. Stir until smooth and bake for one hour."
    zone = f"named_struct('text', '{text}', 'method', 'css_class', 'confidence', 0.9D)"
    df = spark.sql(f"SELECT array({zone}, named_struct('text', repeat('word ', 30), 'method', 'header', 'confidence', 0.85D)) AS z, 'old way' AS l UNION ALL SELECT array(), 'old way' UNION ALL SELECT array(), NULL")
    got = [r["p"] for r in df.select(pipeline.instructions_with_patterns(F.col("z"), F.col("l")).alias("p")).collect()]
    assert got[0]["text"] == text and got[0]["details"]["strategy"] == "structural_css_class" and got[0]["details"]["zone_count"] == 2
    assert got[1]["text"] == "old way" and got[1]["details"]["strategy"] == "original_with_patterns"
    assert got[2]["text"] is None and got[2]["details"]["strategy"] is None


def test_ab_comparison(spark, shelf):
    config = Config.of(use_pattern_extraction=False, enable_ab_testing=True, ab_test_use_new=True)
    row = pipeline.extract_recipes(spark, str(shelf / "book.epub"), config).where("title like 'Golden%'").first()
    ab = json.loads(row["metadata"])["ab_test"]
    assert ab["old_ingredients"].startswith("- 2 cups") and row["ingredients"] == ab["new_ingredients"] and ab["agreement"] and ab["old_success"]


def test_config():
    c = Config.of(Extraction(min_quality_score=5, extract_toc=False), min_quality_score=30, ab_test_log_level="LOUD")
    assert c.extraction.min_quality_score == 30 and not c.extraction.extract_toc and c.ab_testing.log_level is LogLevel.INFO
    assert Config.of().extraction.min_quality_score == 20 and Config.of(ab_test_log_level="DEBUG").ab_testing.log_level is LogLevel.DEBUG
    with pytest.raises(TypeError):
        Config.of(unknown=1)


def test_custom_stage(spark, shelf):
    config = Config.of(stages=(lambda df: df.where("title not like 'Golden%'"),))
    assert pipeline.extract_recipes(spark, str(shelf / "book.epub"), config).where("title like 'Golden%'").count() == 0


def test_toc_and_structure(spark, shelf):
    files = epub.scan_files(spark, str(shelf / "book.epub"))
    toc = analyze.toc_recipes(epub.read_toc(files)).orderBy("ordinal").collect()
    assert [(r["title"], r["category"], r["level"]) for r in toc] == [("Golden honey cake", "Sweets", 1), ("Plain stews of old", None, 0)]
    r = analyze.structure_report(files).first()
    assert (r["title"], r["total_items"], r["document_items"], r["image_items"], r["toc_entries"], r["has_toc"]) == ("The Book", 6, 4, 1, 4, True)
    assert r["header_distribution"]["h2"] == 4 and r["header_distribution"]["h1"] == 1 and r["recipe_indicators"]["serves"] == 1
    text = analyze.format_structure(analyze.structure_report(files)).first()["text"]
    assert "h1: 1\nh2: 4\n" in text and "h3" not in text
    none = analyze.structure_report(epub.scan_files(spark, str(shelf / "plain.epub"))).first()
    assert none["title"] == "plain" and not none["has_toc"]


def test_validation(spark, shelf):
    titles = spark.createDataFrame([(1, "Golden honey cake"), (2, "golden-honey cake!"), (3, "Something else")], "id long, title string")
    r = analyze.validate_extraction(spark, titles, str(shelf / "book.epub")).first()
    assert (r["toc_count"], r["matched"], r["extracted_count"], r["coverage"], r["missing"]) == (2, 1, 3, 0.5, ["Plain stews of old"])
    empty = analyze.validate_extraction(spark, titles, str(shelf / "plain.epub")).first()
    assert (empty["toc_count"], empty["matched"], empty["coverage"], empty["missing"]) == (0, 0, 0.0, [])


def test_fuzzy_match(spark):
    df = spark.createDataFrame([("Honey Cake", "honey cake!"), ("abcd", "bcde"), ("", "x"), (None, "x"), ("?!", "x")], "a string, b string")
    assert [r[0] for r in df.select(analyze.fuzzy_match(F.col("a"), F.col("b"))).collect()] == [1.0, 0.75, 0.0, 0.0, 0.0]


def test_best_match_takes_the_earliest_of_equals(spark):
    a = spark.createDataFrame([(1, "honey cake"), (2, "zzz")], "entry_id long, entry_title string")
    b = spark.createDataFrame([(8, "Honey cake"), (5, "honey cake"), (9, "honey cak")], "title_id long, title string")
    got = {r["entry_id"]: (r["title_id"], r["score"]) for r in analyze.best_matches(a, b).collect()}
    assert got == {1: (5, 1.0), 2: (None, None)}


@pytest.mark.parametrize("block", [1024, 5])
def test_best_matches_equal_all_pairs(spark, block):
    """Against difflib over every pair, with ties, empty titles, lengths that rule each other out and titles of more than 64 characters."""
    rng = random.Random(6)
    words = ["honey", "cake", "grilled", "corn", "of", "the", "old", "stew", "Café", "pie 2"]
    title = lambda: " ".join(rng.choices(words, k=rng.choice((1, 2, 3, 4, 14))))
    garble = lambda t: "".join(c for c in t if rng.random() > 0.15)
    titles = [(i, title()) for i in range(60)] + [(60, None), (61, "?!"), (62, "honey cake"), (63, "Honey Cake!")]
    entries = [(i, garble(rng.choice(titles[:60])[1])) for i in range(60)] + [(60, None), (61, ""), (62, "honey cake"), (63, "zz"), (64, "honey cake")]
    plain = lambda t: re.sub(r"[^\w\s]", "", (t or "").lower()).strip()
    want = {}
    for i, e in entries:
        scored = [(difflib.SequenceMatcher(None, plain(e), plain(t)).ratio(), -k) for k, t in titles if plain(e) and plain(t)]
        best = max(scored, default=(0, 0))
        want[i] = (best[0], -best[1]) if best[0] >= analyze.MATCH else (None, None)
    a, b = spark.createDataFrame(entries, "entry_id long, entry_title string"), spark.createDataFrame(titles, "title_id long, title string")
    got = {r["entry_id"]: (r["score"], r["title_id"]) for r in analyze.best_matches(a, b, block=block).collect()}
    assert got == want


def test_names_of_the_tables_match_as_all_pairs_do(spark):
    """The registered query over its whole tables."""
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test data here")
    from potluck.plans.queries import queries

    plain = lambda t: re.sub(r"[^\w\s]", "", t.lower()).strip()
    titles = [(r["s_suppkey"], plain(r["s_name"])) for r in spark.read.parquet(f"{data}/supplier.parquet").collect()]
    want = {}
    for r in spark.read.parquet(f"{data}/customer.parquet").collect():
        score, k = max((difflib.SequenceMatcher(None, plain(r["c_name"]), t).ratio(), -i) for i, t in titles)
        want[r["c_custkey"]] = (score, -k) if score >= analyze.MATCH else (None, None)
    assert {r["entry_id"]: (r["score"], r["title_id"]) for r in queries()["fuzzy_match_best"](spark, data).collect()} == want


def test_a_bound_is_never_below_the_ratio():
    rng = random.Random(1)
    for n in (1, 5, 30, 64, 70):
        titles = ["".join(rng.choices("abcd ", k=n)) for _ in range(20)]
        index = {c: i for i, c in enumerate("abcd ")}
        codes = np.array([[index[c] for c in t] for t in titles])
        for x in (1, 12, 64, 65, 90):
            e = "".join(rng.choices("abcde ", k=x))
            for t, most in zip(titles, analyze._bounds(e, codes, index)):
                assert difflib.SequenceMatcher(None, e, t).ratio() <= most + 1e-12


def page(spark, *contents):
    rows = [("b", "a", f"i{i}", i, "c", c) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "book string, author string, item_name string, item_ordinal int, chapter string, content string")


def test_deep_markup(spark):
    deep = "<div>" * 3000 + "<h2>Deep stew</h2><p>" + "words " * 30 + "</p>" + "</div>" * 3000
    rows = pipeline.split_sections(page(spark, deep, f"<section>{deep}</section>")).collect()
    assert len(rows) == 2 and all(r["failure"] is None and "Deep stew" in r["text"] for r in rows)


def picky(markup):
    if "poison" in str(markup):
        raise ValueError("cannot read this")
    return parse(markup)


def test_a_document_that_fails_leaves_the_others(spark):
    docs = page(spark, DISH.format(title="Golden honey cake"), DISH.format(title="poison"), DISH.format(title="Second cake"))
    config = Config.of(components=Components(parser=picky))
    bad = pipeline.split_sections(docs, config.components).where("failure is not null").collect()
    assert [(r["item_ordinal"], r["failure"], r["text"]) for r in bad] == [(1, "ValueError: cannot read this", None)]
    assert sorted(r["title"] for r in pipeline.extract_from_documents(docs, config).collect()) == ["Golden honey cake", "Second cake"]


def test_zones_that_fail_fall_back_to_the_cascade(spark, monkeypatch):
    def broken(root):
        raise RuntimeError("no zones today")

    monkeypatch.setattr(pipeline, "ingredient_zones", broken)
    zone_text, method, sure, n, legacy, *_, failure = pipeline._parts(parse(DISH), "", Components())
    assert (zone_text, method, sure, n, failure) == (None, None, None, 0, "pattern_extraction_error: no zones today") and legacy.startswith("- 2 cups")
    df = spark.createDataFrame([(legacy, failure), (None, failure)], "legacy string, failure string")
    nothing = F.lit(None)
    p = pipeline.ingredients_with_patterns(nothing.cast("string"), nothing.cast("string"), nothing.cast("double"), F.lit(0), F.col("legacy"), F.col("failure"))
    first, second = (json.loads(r["d"]) | {"text": r["text"]} for r in df.select(F.to_json(p["details"]).alias("d"), p["text"].alias("text")).collect())
    assert first == {"strategy": "legacy_fallback", "confidence": 0.5, "linguistic_score": 0.0, "combined_score": 0.5, "fallback_reason": failure, "text": legacy}
    assert second == {"text": None}


def two_lines(root, text):
    return "\n".join(text.split("\n")[:2]), {"strategy": "mine"}


def last_line(root, text):
    return text.split("\n")[-1]


def test_replaced_components(spark):
    fields = F.struct(*[F.lit(n).alias(n) for n in ("serves", "prep_time", "cook_time", "cooking_method", "protein_type")])
    use = Components(
        ingredients=two_lines, instructions=last_line, validator=lambda text, title: title.startswith("Golden"), metadata=lambda text, title: fields, scorer=lambda i, *rest: F.length(i)
    )
    docs = page(spark, DISH.format(title="Golden honey cake"), DISH.format(title="Second cake"))
    r = pipeline.extract_from_documents(docs, Config.of(components=use)).collect()
    assert [(x["title"], x["ingredients"], x["instructions"], x["serves"], x["quality_score"], x["metadata"]) for x in r] == [
        ("Golden honey cake", "Golden honey cake\nServes 6", "Remove, let it cool and serve warm.", "serves", 26, None)
    ]


def test_comparison_messages(spark):
    rows = [("a", True, True, True, 0.5), ("b", False, True, False, 0.25), ("c", True, False, False, None)]
    df = spark.createDataFrame([(t, json.dumps({"ab_test": {"agreement": g, "old_success": o, "new_success": n, "confidence": c}})) for t, g, o, n, c in rows] + [("d", None)], "title string, metadata string")
    apart = ("b", "WARNING", "A/B DISAGREEMENT: old=True, new=False, confidence=0.25")
    got = {level: [tuple(r) for r in abtest.messages(df, level).orderBy("title").collect()] for level in ("DEBUG", "INFO", "WARNING", "NONE")}
    assert got["INFO"] == [apart] and got["WARNING"] == got["NONE"] == []
    assert got["DEBUG"] == [("a", "DEBUG", "A/B AGREEMENT: both succeeded"), apart, ("c", "DEBUG", "A/B AGREEMENT: both failed")]


def test_a_folder_is_no_file(spark, tmp_path):
    (tmp_path / "x.epub").mkdir()
    with pytest.raises(ValueError, match="no file"):
        pipeline.extract_recipes(spark, str(tmp_path / "x.epub"))


def test_streaming_ingest_reads_each_file_once(spark, shelf, tmp_path):
    folder, store, checkpoint = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "cp")
    folder.mkdir()
    make_epub(folder / "a.epub")
    ingest_folder(spark, str(folder), store, checkpoint).awaitTermination(120)
    first = RecipeStore(spark, store).count()
    make_epub(folder / "b.epub", title="Second")
    ingest_folder(spark, str(folder), store, checkpoint).awaitTermination(120)
    s = RecipeStore(spark, store)
    assert first > 0 and s.count() == 2 * first and s.count({"book": "Second"}) == first


def test_cli(spark, shelf, tmp_path, capsys):
    store = str(tmp_path / "store")
    assert cli(spark, ["extract", str(shelf / "book.epub"), "--store", store]) == 0
    cli(spark, ["search", "honey", "--store", store])
    cli(spark, ["list-tags", "--store", store])
    cli(spark, ["validate", str(shelf / "book.epub"), "--store", store])
    cli(spark, ["analyze", str(shelf / "book.epub")])
    cli(spark, ["ab-report", "--store", store])
    cli(spark, ["batch", str(shelf), "--store", store + "2", "--verbose"])
    cli(spark, ["extract", str(shelf / "book.epub"), "--store", store + "3", "-v"])
    cli(spark, ["analyze", str(shelf / "book.epub"), "-v"])
    cli(spark, ["export", "--store", store, "--format", "vault", "--output", str(tmp_path / "vault"), "-v"])
    cli(spark, ["export", "--store", store, "--format", "json", "--output", str(tmp_path / "r.json")])
    cli(spark, ["export", "--store", store, "--format", "markdown", "--output", str(tmp_path / "r.md")])
    out = capsys.readouterr().out
    assert "saved" in out and "Golden honey cake" in out and "NO DISAGREEMENTS FOUND" in out and "Total items: 6" in out
    assert "broken.epub" in out and "one.xhtml#top" in out and parser().parse_args(["query-tags", "x"]).limit == 20
    data = json.loads((tmp_path / "r.json").read_text())
    assert data["metadata"]["format_version"] == "1.0" and data["metadata"]["count"] == len(data["recipes"]) > 0
    assert (tmp_path / "r.md").read_text().startswith("# Recipe Collection\n\nTotal Recipes: ")


def test_a_name_sees_few_of_many_titles():
    names, texts = [f"customer{i:06d}" for i in range(0, 9000, 9)], [f"supplier{i:06d}" for i in range(3000)]
    tree = analyze._Tree(texts)
    masks = np.zeros((len(names), len(tree.index) + 1), np.uint64)
    for k, name in enumerate(names):
        for i, c in enumerate(name):
            if c in tree.index:
                masks[k, tree.index[c]] |= np.uint64(1 << i)
    name, node, common, missed, seen = tree.near(masks, 14, 9, 1 << 21)
    # exactly those with the same number have three letters and six digits in common
    assert sorted((names[i][-6:], texts[tree.order[n]][-6:]) for i, n in zip(name, node)) == [(f"{i:06d}",) * 2 for i in range(0, 3000, 9)]
    assert set(common.tolist()) == {9} and missed == 8 and seen < len(names) * len(texts) // 20


def test_a_pass_over_markup_holds_few_rows_at_a_time(spark):
    import gc

    import pandas as pd

    from potluck.sources.dom import Node

    markup = "<html><body><section><h2>Golden cake</h2><p>Serves 4</p><ul class='ingredients'><li>2 cups flour</li><li>1 tsp salt</li></ul></section></body></html>"
    frame = pd.DataFrame([("b", "a", f"p{i}", 0, "c", markup) for i in range(1000)])
    gc.collect()
    gc.disable()
    try:
        sizes, nodes = [], []
        for out in pipeline._sections_and_parts(Components(), 0)(iter([frame])):
            sizes.append(len(out))
            nodes.append(sum(isinstance(x, Node) for x in gc.get_objects()))
    finally:
        gc.enable()
    assert sum(sizes) == 1000 and max(sizes) <= pipeline.ROWS and max(nodes) < 100


def test_a_recipe_is_scored_once(spark):
    """No filter on a score or a text brings a second computation of it."""
    df = pipeline.extract_from_documents(page(spark, RECIPE))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("tablespoon|teaspoon|liter|cup|gram") == 1
