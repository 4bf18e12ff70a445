"""Queries of the operators on markup, archives, store and exports, over pages, books and rows made from the given tables."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from potluck.functions import batch, details
from potluck.functions import metadata as meta
from potluck.functions.text import six
from potluck.operators import abtest, analyze, export, quality
from potluck.operators.store import RecipeStore, tag_counts
from potluck.sources import epub
from potluck.sources.dom import clean_lines, list_items, parse, release
from potluck.sources.shared import fresh_path
from potluck.sources.tables import read_table, spread
from potluck.streaming.ingest import ingest_folder

from . import oracle as o
from . import pipeline, shapes
from .books import ITEMS, STEPS, archive
from .registry import register

# shapes of pages


def _filled(template: Column, key: Column, name: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{k}"), key.cast("string")), F.lit("{name}"), name)


def _shaped(spark: SparkSession, sf_dir: str, pages: list[tuple[str, str]]) -> DataFrame:
    """(id, shape, markup): a page of every shape for each supplier."""
    every = F.explode(F.array(*[F.struct(F.lit(n).alias("shape"), F.lit(m).alias("markup")) for n, m in pages])).alias("p")
    rows = spread(read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")).select("s_suppkey", "s_name", every)
    return rows.select(F.col("s_suppkey").alias("id"), F.col("p.shape").alias("shape"), _filled(F.col("p.markup"), F.col("s_suppkey"), F.col("s_name")).alias("markup"))


def _zones(spark: SparkSession, sf_dir: str, kind: str, pages: dict) -> DataFrame:
    return pipeline.zone_table(_shaped(spark, sf_dir, shapes.markup(pages)), "id", "shape").where(F.col("kind") == kind)


@register(shapes.zones_sql(shapes.INGREDIENT_ZONES))
def ingredient_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ING12 to ING20, SET1, SRT6, WIN2, WIN3."""
    return _zones(spark, sf_dir, "ingredients", shapes.INGREDIENT_ZONES).select("id", "shape", "ord", "method", "confidence", "text")


@register(shapes.legacy_sql())
def legacy_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ING21, SET4, WIN7."""
    return _zones(spark, sf_dir, "legacy", shapes.LEGACY_ZONES).select("id", "shape", "ord", "text")


@register(shapes.zones_sql(shapes.INSTRUCTION_ZONES))
def instruction_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INS13 to INS18, SET2."""
    return _zones(spark, sf_dir, "instructions", shapes.INSTRUCTION_ZONES).select("id", "shape", "ord", "method", "confidence", "text")


@register(shapes.metadata_sql())
def metadata_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET6 to MET12, MET14, MET15, SET3, JOI10."""
    rows = _zones(spark, sf_dir, "metadata", shapes.METADATA_ZONES)
    return rows.select("id", "shape", "ord", "method", "confidence", F.array_join("field_hints", ",").alias("hints"), "text")


def _strategies(spark: SparkSession, sf_dir: str, kind: str, pages: dict) -> DataFrame:
    found = pipeline.strategy_table(_shaped(spark, sf_dir, shapes.markup(pages)), "id", "shape")
    return found.where((F.col("kind") == kind) & F.col("text").isNotNull()).select("id", "shape", "strategy", "text")


@register(shapes.strategies_sql(shapes.INGREDIENT_STRATEGIES))
def ingredient_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ING2 to ING5, ING8 to ING10, WIN4, DOM3, DOM4: each strategy by itself and the cascade."""
    return _strategies(spark, sf_dir, "ingredients", shapes.INGREDIENT_STRATEGIES)


@register(shapes.strategies_sql(shapes.INSTRUCTION_STRATEGIES))
def instruction_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INS1 to INS6, INS8, INS9, INS11, WIN5: each strategy by itself and the cascade."""
    return _strategies(spark, sf_dir, "instructions", shapes.INSTRUCTION_STRATEGIES)


def _documents(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit("b").alias("book"), F.lit("a").alias("author"), F.col("shape").alias("item_name"), F.col("id").cast("int").alias("item_ordinal"), F.lit("c").alias("chapter"), F.col("markup").alias("content"))


@register(shapes.expected([(shape, i, t, x) for shape, (_, parts) in shapes.SPLITS.items() for i, (t, x) in enumerate(parts)], ["shape", "section_ordinal", "title", "text"], "title"))
def split_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM1, DOM2, DOM5 to DOM7, AGG11: sections and titles of pages of every kind."""
    found = pipeline.split_sections(_documents(_shaped(spark, sf_dir, shapes.markup(shapes.SPLITS))))
    return found.select(F.col("item_ordinal").cast("long").alias("id"), F.col("item_name").alias("shape"), "section_ordinal", "title", "text")


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("text", "glued", "items", "headers")]))
def _lookups(markup: pd.Series) -> pd.DataFrame:
    rows = []
    for m in markup:
        root = parse(m)
        rows.append((clean_lines(root), root.find("body")[0].glued(" "), "|".join(x for n in root.find("ul", "ol") for x in list_items(n)), ",".join(f"{n.tag}:{n.glued()}" for n in root.find("h1", "h2"))))
    return pd.DataFrame(rows, columns=["text", "glued", "items", "headers"])


@register(
    "SELECT s_suppkey AS id, 'One & two' || chr(10) || s_name || chr(10) || 'a' || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'end' AS text, 'One & two ' || s_name || ' a b c end' AS glued, "
    "'a|b c' AS items, 'h1:One & two' AS headers FROM supplier"
)
def dom_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM1 to DOM3 on markup that needs repairs: open items and paragraphs, entities, script and style, upper-case tags."""
    page = "<html><body><H1>One &amp; two</H1><p>{name}<ul><li>a<li>b <i>c</i></ul><script>x</script><style>y</style>end"
    return _shaped(spark, sf_dir, [("x", page)]).select("id", _lookups("markup").alias("m")).select("id", "m.*")


# what the zones and cascades are worth


def _choice_sql(pages: dict, base: dict, parts: dict, score: dict, linguistic: str) -> str:
    rows = [(n, i, method, sure, count, text) for i, (n, (_, _, (method, sure, count, text))) in enumerate(pages.items())]
    e = shapes.expected(rows, ["shape", "place", "strategy", "sure", "zone_count", "text"])
    return (
        f"WITH e AS MATERIALIZED ({e}), d AS MATERIALIZED (SELECT id * 100 + place AS doc_id, text FROM e), p AS MATERIALIZED ({o.levels(base, parts, score, 'd')}), "
        f"l AS MATERIALIZED ({o.levels(o.LINGUISTIC_BASE, {}, o.LINGUISTIC_SCORES, 'd')}) SELECT e.id, e.shape, nullif(e.strategy, '') AS strategy, e.zone_count, nullif(e.text, '') AS text, "
        f"round(p.confidence, 4) AS confidence, round(l.{linguistic}, 4) AS linguistic_score, "
        f"round(CASE WHEN e.text = '' THEN 0 WHEN e.sure > 0 THEN e.sure * 0.3 + p.confidence * 0.5 + l.{linguistic} * 0.2 ELSE p.confidence * 0.7 + l.{linguistic} * 0.3 END, 4) AS combined_score "
        "FROM e JOIN p ON p.doc_id = e.id * 100 + e.place JOIN l ON l.doc_id = p.doc_id"
    )


@register(_choice_sql(shapes.INGREDIENT_CHOICES, o.INGREDIENT_BASE, o.INGREDIENT_PARTS, {"confidence": o.INGREDIENT_SCORE}, "ingredient_score"))
def ingredient_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ING1, ING11, AGG14: the surest zone, or the cascade where its score is too low, with the scores."""
    rows = _shaped(spark, sf_dir, [(n, m) for n, (m, _, _) in shapes.INGREDIENT_CHOICES.items()])
    whole = rows.withColumn("item_name", F.col("shape")).select(
        F.lit("b").alias("book"), F.lit("a").alias("author"), "item_name", F.col("id").cast("int").alias("item_ordinal"), F.lit("c").alias("chapter"), F.lit(0).alias("section_ordinal"), F.col("shape").alias("title"), _lines("markup").alias("text"), "markup"
    )
    p = pipeline.extract_parts(whole)
    c = pipeline.ingredients_with_patterns(F.col("zone_text"), F.col("zone_method"), F.col("zone_confidence"), F.col("zone_count"), F.col("legacy_ingredients"), F.col("failure"))
    return p.select(F.col("item_ordinal").cast("long").alias("id"), F.col("item_name").alias("shape"), c.alias("c")).select(
        "id",
        "shape",
        F.concat_ws(" ", "c.details.strategy", F.when(F.col("c.details.strategy") == "structural_zones", F.col("c.details.detection_method"))).alias("strategy"),
        "c.details.zone_count",
        "c.text",
        *[F.round(f"c.details.{n}", 4).alias(n) for n in ("confidence", "linguistic_score", "combined_score")],
    ).withColumn("strategy", F.nullif("strategy", F.lit("")))


@F.pandas_udf(T.StringType())
def _lines(markup: pd.Series) -> pd.Series:
    def one(m: str) -> str:
        root = parse(m)
        text = clean_lines(root)
        release(root)
        return text

    return markup.map(one)


@register(_choice_sql(shapes.INSTRUCTION_CHOICES, o.INSTRUCTION_BASE, o.INSTRUCTION_PARTS, {"confidence": o.INSTRUCTION_SCORE}, "instruction_score").replace(
    ", round(CASE WHEN e.text = '' THEN 0 WHEN e.sure > 0 THEN e.sure * 0.3 + p.confidence * 0.5 + l.instruction_score * 0.2 ELSE p.confidence * 0.7 + l.instruction_score * 0.3 END, 4) AS combined_score", ""
))
def instruction_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INS12: the zone with the best score, or the cascade."""
    rows = _shaped(spark, sf_dir, [(n, m) for n, (m, _, _) in shapes.INSTRUCTION_CHOICES.items()])
    whole = rows.select(
        F.lit("b").alias("book"), F.lit("a").alias("author"), F.col("shape").alias("item_name"), F.col("id").cast("int").alias("item_ordinal"), F.lit("c").alias("chapter"), F.lit(0).alias("section_ordinal"), F.col("shape").alias("title"), _lines("markup").alias("text"), "markup"
    )
    p = pipeline.extract_parts(whole)
    c = pipeline.instructions_with_patterns(F.col("instruction_zones"), F.col("legacy_instructions"))
    return p.select(F.col("item_ordinal").cast("long").alias("id"), F.col("item_name").alias("shape"), c.alias("c")).select(
        "id", "shape", "c.details.strategy", "c.details.zone_count", "c.text", *[F.round(f"c.details.{n}", 4).alias(n) for n in ("confidence", "linguistic_score")]
    )


# metadata


@register(
    "SELECT s_suppkey AS id, v.* FROM (SELECT s_suppkey, s_suppkey % 50 + 1 AS k FROM supplier) s, LATERAL (SELECT * FROM (VALUES "
    "('zones', 'structural', 1, CAST(k AS VARCHAR), NULL, NULL, NULL, NULL, NULL), ('zone without fields', 'legacy', 1, NULL, '20', NULL, 'bake', 'lamb', NULL), "
    "('no zone', 'legacy', 0, k || '-' || (k + 2), '20', '60', 'bake', 'lamb', NULL), ('level', 'structural', 1, NULL, NULL, NULL, NULL, NULL, 'easy')) "
    "t(shape, strategy, zone_count, serves, prep_time, cook_time, cooking_method, protein_type, difficulty)) v"
)
def metadata_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET5, MET13: fields from zones if they give any, else from the text."""
    k = (F.col("s_suppkey") % 50 + 1).cast("string")
    kinds = [
        ("zones", F.concat(F.lit("Serves "), k, F.lit(" people")), 1, F.lit("Prep time: 20 minutes. Bake the lamb")),
        ("zone without fields", F.lit("nothing to see"), 1, F.lit("Prep time: 20 minutes\nBake the lamb")),
        ("no zone", F.lit(None).cast("string"), 0, F.concat(F.lit("Serves: "), k, F.lit(" to "), F.col("s_suppkey") % 50 + 3, F.lit("\nPrep time: 20 minutes\nCook time: 1 hour\nBake the lamb"))),
        ("level", F.lit("easy level"), 1, F.lit("Bake it")),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("shape"), z.alias("zone"), F.lit(c).alias("n"), t.alias("text")) for n, z, c, t in kinds])).alias("r")
    rows = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), each)
    m = meta.metadata_with_patterns(F.col("r.zone"), F.col("r.n"), F.col("r.text"), F.lit("A title"))
    return rows.select("id", "r.shape", m.alias("m")).select("id", "shape", "m.strategy", "m.zone_count", "m.fields.*")


@register(
    "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_size || '-' || (p_size + 2) WHEN 1 THEN CAST(p_size AS VARCHAR) END AS serves, "
    "CASE WHEN p_partkey % 2 = 0 THEN CAST(60 + p_size AS VARCHAR) END AS prep_time, p_name AS kept FROM part"
)
def validate_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET4, 2.14-15: a map of fields parsed again, without blank and unreadable ones."""
    z, k = F.col("p_size"), F.col("p_partkey")
    serves = F.when(k % 3 == 0, F.concat(z, F.lit(" to "), z + 2, F.lit(" (people)"))).when(k % 3 == 1, z.cast("string")).otherwise("  ")
    prep = F.when(k % 2 == 0, F.concat(F.lit("1 hour "), z, F.lit(" min"))).otherwise("later")
    m = meta.validate_metadata(F.create_map(F.lit("serves"), serves, F.lit("prep_time"), prep, F.lit("kept"), F.col("p_name"), F.lit("blank"), F.lit(" ")))
    rows = read_table(spark, sf_dir, "part").select(k.alias("id"), m.alias("m"))
    return rows.where(F.size(F.map_filter("m", lambda n, _: n == "blank")) == 0).select("id", *[F.element_at("m", n).alias(n) for n in ("serves", "prep_time", "kept")])


_RAW = {"servings": "'serves ' || z", "time": "'prep time: ' || z || ' minutes'"}


@register(
    "WITH t AS (SELECT p_partkey AS id, CAST(p_size AS VARCHAR) AS z FROM part) SELECT id, z AS servings, "
    f"round({o.confidence('(' + _RAW['servings'] + ')', 'servings')}, 6) AS servings_confidence, z || ' minutes' AS prep_time, round({o.confidence('(' + _RAW['time'] + ')', 'time')}, 6) AS prep_confidence, 'grill' AS method FROM t"
)
def detected_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET13: fields with the confidence of what they were read from."""
    text = F.concat(F.lit("Grill it.\nServes "), "p_size", F.lit("\nPrep time: "), "p_size", F.lit(" minutes\nrest"))
    rows = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), meta.detected_metadata(text, F.lit("A title")).alias("m"))
    return rows.select(
        "id", F.col("m.servings.value").alias("servings"), F.round("m.servings.confidence", 6).alias("servings_confidence"), F.col("m.prep_time.value").alias("prep_time"), F.round("m.prep_time.confidence", 6).alias("prep_confidence"), F.col("m.cooking_method.value").alias("method")
    )


@register(o.levels(o.INGREDIENT_BASE, o.INGREDIENT_PARTS, {"confidence": o.INGREDIENT_SCORE, "line_count": "len(ls)"}))
def extract_with_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCO12."""
    d = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", batch.ingredient_scores(F.col("text")).alias("c"))
    return d.select("doc_id", six(F.col("c.confidence")).alias("confidence"), F.col("c.line_count").cast("double").alias("line_count"))


@register(
    "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 97) / 97.0::DOUBLE END AS confidence, CASE WHEN doc_id % 3 <> 0 THEN source END AS strategy, "
    "CASE WHEN doc_id % 3 <> 0 THEN lang END AS kept, 'new' AS merged FROM documents"
)
def extraction_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.14-15: details under a recipe's metadata, read and merged."""
    sure = (F.col("doc_id") % 97) / 97.0
    given = F.to_json(F.struct(F.col("lang").alias("note"), F.struct(F.struct(sure.alias("confidence"), F.col("source").alias("strategy")).alias("ingredients")).alias("extraction")))
    m = F.when(F.col("doc_id") % 3 != 0, given)
    merged = details.merge_extraction(F.col("m"), F.lit('{"strategy":"new"}'), "instructions")
    rows = read_table(spark, sf_dir, "documents").select("doc_id", m.alias("m")).withColumn("all", merged)
    return rows.select(
        "doc_id",
        details.extraction_confidence(F.col("all"), "ingredients").alias("confidence"),
        details.extraction_strategy(F.col("all"), "ingredients").alias("strategy"),
        F.get_json_object("all", "$.note").alias("kept"),
        details.extraction_strategy(F.col("all"), "instructions").alias("merged"),
    )


# archives


def _shelf(spark: SparkSession, sf_dir: str) -> str:
    """A folder with one archive per nation that has suppliers."""
    folder = fresh_path(spark, "shelf")
    plain = folder.removeprefix("file://")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            os.makedirs(plain, exist_ok=True)
            for key, name, suppliers in frame.itertuples(index=False):
                with open(f"{plain}/{name}.epub", "wb") as f:
                    f.write(archive(key, name, list(suppliers)))
            yield pd.DataFrame({"n": [len(frame)]})

    s, n = read_table(spark, sf_dir, "supplier"), read_table(spark, sf_dir, "nation")
    books = n.join(s, n["n_nationkey"] == s["s_nationkey"]).groupBy("n_nationkey", "n_name").agg(F.collect_list(F.struct("s_suppkey", "s_name")).alias("suppliers"))
    books.mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return folder


_BOOKS = (
    "WITH n AS (SELECT n_nationkey AS key, n_name AS stem, CASE WHEN n_nationkey % 5 IN (0, 1) THEN n_name ELSE 'Cakes of ' || n_name END AS book, "
    "CASE n_nationkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Unknown' ELSE 'Baker ' || n_nationkey END AS author, n_nationkey % 5 <> 0 AS good FROM nation "
    "WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)), "
    "s AS (SELECT n.*, s_suppkey AS k, s_name AS name, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INTEGER AS place, s_suppkey % 2 = 0 AS even FROM supplier JOIN n ON n.key = s_nationkey) "
)


@register(_BOOKS + "SELECT book, author, 's' || k || '.xhtml' AS item_name, place AS item_ordinal, CASE WHEN even THEN 'Golden cake of ' || name ELSE 'Unknown' END AS chapter, false AS failed FROM s WHERE good UNION ALL SELECT book, NULL, NULL, NULL, NULL, true FROM n WHERE NOT good")
def epub_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1 to SRC4: documents of a folder of archives with their chapters; an unreadable one is one row."""
    found = epub.read_documents(epub.scan_files(spark, _shelf(spark, sf_dir)))
    return found.select("book", "author", "item_name", "item_ordinal", "chapter", F.col("error").isNotNull().alias("failed"))


@register(_BOOKS + "SELECT book, 's' || k || '.xhtml' AS item_name, CASE WHEN even THEN 'Golden cake of ' || name ELSE 'Unknown' END AS chapter FROM s WHERE good")
def epub_chapter_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI7 over tables."""
    files = epub.scan_files(spark, _shelf(spark, sf_dir))
    return epub.chapter_join(epub.read_documents(files).where("error is null"), epub.read_toc(files)).select("book", "item_name", "chapter")


@register(
    _BOOKS + "SELECT book, 'Golden cake of ' || name AS title, 's' || k || '.xhtml' AS href, NULL AS category, 0 AS level FROM s WHERE good AND even UNION ALL "
    "SELECT book, 'Wurzburg pizzazz muffin ' || k, 's' || k || '.xhtml#top', 'Sweets and more', 1 FROM s WHERE good AND NOT even"
)
def epub_toc_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6, FIL8: leaves of the tables of contents that look like recipes."""
    return analyze.toc_recipes(epub.read_toc(epub.scan_files(spark, _shelf(spark, sf_dir)))).select("book", "title", "href", "category", "level")


@register(
    _BOOKS + ", c AS (SELECT key, count(*) AS docs, count(*) + (count(*) > count(*) FILTER (even))::INT AS toc FROM s GROUP BY key) SELECT book AS title, author, CASE WHEN good THEN docs + 2 ELSE 0 END AS total_items, "
    "CASE WHEN good THEN docs ELSE 0 END AS document_items, good::BIGINT AS image_items, CASE WHEN good THEN toc ELSE 0 END AS toc_entries, good AS has_toc, CASE WHEN good THEN docs END AS h2, CASE WHEN good THEN docs END AS serves, "
    "CASE WHEN good THEN 0::BIGINT END AS yields FROM n JOIN c USING (key)"
)
def epub_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7, DOM10, DOM11, AGG12."""
    r = analyze.structure_report(epub.scan_files(spark, _shelf(spark, sf_dir)))
    return r.select(
        "title", "author", "total_items", "document_items", "image_items", "toc_entries", "has_toc", F.col("header_distribution.h2").alias("h2"), F.col("recipe_indicators.serves").alias("serves"), F.col("recipe_indicators.yield").alias("yields")
    )


@register(
    _BOOKS + ", c AS (SELECT book, author, count(*) AS d, count(*) + (count(*) > count(*) FILTER (even))::INT AS toc FROM s WHERE good GROUP BY ALL) SELECT book, 'Title: ' || book || chr(10) || 'Author: ' || author || chr(10) || "
    "'Total items: ' || (d + 2) || chr(10) || 'Document items: ' || d || chr(10) || 'TOC entries: ' || toc || chr(10) || 'h2: ' || d || chr(10) || "
    + " || chr(10) || ".join(f"'''{w}'': found in ' || {n} || '/' || d || ' documents'" for w, n in (("ingredients", "d"), ("prep time", "d"), ("serves", "d"), ("cook time", "0"), ("directions", "0"), ("instructions", "0"), ("yield", "0")))
    + " AS text FROM c"
)
def epub_structure_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK12."""
    r = analyze.structure_report(epub.scan_files(spark, _shelf(spark, sf_dir))).where("error is null")
    return analyze.format_structure(r).join(r.select("path", F.col("title").alias("book")), "path").select("book", "text")


_FOUND = "'2 cups flour' || chr(10) || '3 tablespoons sugar' || chr(10) || '1 tsp salt' || chr(10) || '3 large eggs'"


@register(_BOOKS + f"SELECT book, author, 'Golden cake of ' || name AS title, CASE WHEN even THEN 'Golden cake of ' || name ELSE 'Unknown' END AS chapter, {_FOUND} AS ingredients, CAST(k % 9 + 1 AS VARCHAR) AS serves FROM s WHERE good")
def epub_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12, SET7: recipes of a folder of archives."""
    return pipeline.extract_recipes(spark, _shelf(spark, sf_dir)).select("book", "author", "title", "chapter", "ingredients", "serves")


@register(_BOOKS + "SELECT (SELECT count(*) FROM n WHERE good) AS files_ok, (SELECT count(*) FROM n WHERE NOT good) AS files_failed, (SELECT count(*) FROM s WHERE good) AS recipes")
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5, AGG8, SNK13: a folder read as a batch, with the files that failed."""
    recipes, files = pipeline.batch(spark, _shelf(spark, sf_dir))
    return quality.batch_summary(files, recipes).select("files_ok", "files_failed", "recipes")


@register(_BOOKS + "SELECT book, 'Golden cake of ' || name AS title FROM s WHERE good")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder as a stream into a store, started twice: what was read is not read again."""
    folder, store, at = _shelf(spark, sf_dir), fresh_path(spark, "store"), fresh_path(spark, "stream")
    for _ in range(2):
        ingest_folder(spark, folder, store, at).awaitTermination()
    return RecipeStore(spark, store).recipes.select("book", "title")


@register(
    _BOOKS + ", t AS (SELECT * FROM s WHERE good) SELECT count(*) AS toc_count, count(*) FILTER (even) AS matched, coalesce(avg(even::INT), 0) AS coverage, (SELECT count(*) FROM t) AS extracted_count, "
    "coalesce(string_agg(CASE WHEN NOT even THEN 'Wurzburg pizzazz muffin ' || k END, ',' ORDER BY k), '') AS missing FROM t"
)
def toc_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI6, AGG13, WIN1: entries of the tables of contents against the recipes found."""
    folder = _shelf(spark, sf_dir)
    toc = analyze.toc_recipes(epub.read_toc(epub.scan_files(spark, folder)))
    number = F.regexp_extract("href", r"s(\d+)", 1).cast("long")
    recipes = pipeline.extract_recipes(spark, folder).select(F.xxhash64("title").alias("title_id"), "title")
    r = analyze.validation(analyze.best_matches(toc.select(number.alias("entry_id"), F.col("title").alias("entry_title")), recipes), recipes)
    return r.select("toc_count", "matched", "coverage", "extracted_count", F.array_join("missing", ",").alias("missing"))


@register("SELECT s_suppkey AS id, 'Golden cake of ' || s_name AS title, '2 cups flour' || chr(10) || '3 tablespoons sugar' || chr(10) || '1 tsp salt' || chr(10) || '3 large eggs of ' || s_name AS ingredients, '20' AS prep_time, 'bake' AS cooking_method FROM supplier")
def extract_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC11: one section taken as one recipe."""
    items = ITEMS.replace("3 large eggs", "3 large eggs of {name}")
    page = f"<h2>Golden cake of {{name}}</h2><p>Prep time: 20 minutes</p><ul class='ingredients'>{items}</ul><ol>{STEPS}</ol>"
    rows = _shaped(spark, sf_dir, [("x", page)]).select(F.regexp_extract("markup", "<h2>(.*?)</h2>", 1).alias("title"), F.col("id").cast("string").alias("book"), F.lit("a").alias("author"), "markup")
    return pipeline.extract_from_section(rows).select(F.col("book").cast("long").alias("id"), "title", "ingredients", "prep_time", "cooking_method")


# store


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as recipes; the key stands for the score, so no two are equal."""
    k = F.col("p_partkey")
    return spread(read_table(spark, sf_dir, "part")).select(
        F.concat(F.col("p_name"), F.lit(" "), k).alias("title"), F.col("p_brand").alias("book"), F.lit("1 cup").alias("ingredients"), F.when(k % 2 == 0, F.col("p_type")).alias("instructions"), k.cast("int").alias("quality_score"),
        F.array(F.concat(F.lit(" "), F.col("p_type")), F.upper("p_type"), F.lit(" "), F.split("p_name", " ")[0]).alias("tags"), F.when(k % 4 == 0, F.lit('{"a":1}')).alias("metadata"),
    )


def _stored(spark: SparkSession, sf_dir: str) -> RecipeStore:
    """Saved as two batches, of which the second is saved under its key twice."""
    s = RecipeStore(spark, fresh_path(spark, "store"))
    rows = _parts(spark, sf_dir)
    s.save(rows.where("quality_score % 2 = 0"))
    for _ in range(2):
        s.save(rows.where("quality_score % 2 = 1"), key="odd")
    return s


_SAVED = (
    "WITH r AS (SELECT p_partkey AS k, p_name || ' ' || p_partkey AS title, p_brand AS book, lower(trim(p_type)) AS kind, lower(string_split(p_name, ' ')[1]) AS look, "
    "CASE WHEN p_partkey % 4 = 0 THEN '{\"a\":1}' ELSE '{}' END AS metadata FROM part), "
    "g AS (SELECT k, kind AS tag FROM r UNION SELECT k, look FROM r), a AS (SELECT k, string_agg(tag, ',' ORDER BY tag) AS tags FROM g GROUP BY k) "
)


@register(_SAVED + "SELECT title, book, k::INTEGER AS quality_score, tags, metadata FROM r JOIN a USING (k)")
def store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1, SNK3, SNK4, SRC8, SRC9: what was saved, with tags and metadata; ids are new for every row."""
    s = _stored(spark, sf_dir)
    return s.query().select("title", "book", "quality_score", F.array_join("tags", ",").alias("tags"), "metadata")


@register(_SAVED + "SELECT title, k::INTEGER AS quality_score, tags FROM r JOIN a USING (k) WHERE kind = 'promo' OR look = 'cold' ORDER BY k DESC LIMIT 7")
def store_limited_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT1, SRT2: the seven best with any of two tags."""
    return _stored(spark, sf_dir).query(limit=7, tags=["Promo", "cold"], tags_match_all=False).select("title", "quality_score", F.array_join("tags", ",").alias("tags"))


@register(_SAVED + "SELECT title FROM r WHERE book = 'Brand#13' AND k >= 10 AND kind = 'economy' AND look = 'cold'")
def store_filtered_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL9, FIL10, FIL13 on stored tables."""
    return _stored(spark, sf_dir).query({"book": "Brand#13", "author": None}, min_quality=10, tags=["economy", "cold"]).select("title")


@register("SELECT tag_name, count(*) AS count FROM (SELECT p_partkey, lower(p_type) AS tag_name FROM part UNION SELECT p_partkey, lower(string_split(p_name, ' ')[1]) FROM part) GROUP BY tag_name UNION ALL SELECT 'unused', 0")
def store_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI4, AGG4 on stored tables, with a tag that no recipe has."""
    s = _stored(spark, sf_dir)
    return tag_counts(s.recipe_tags, s.tags.union(spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("unused").alias("tag_name"))))


@register("SELECT * FROM (VALUES (1, 'First schema, with tags', 2), (2, 'Metadata as JSON', 2)) t(version, description, latest)")
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2, AGG6: a store opened twice has each version once."""
    path = fresh_path(spark, "store")
    RecipeStore(spark, path)
    s = RecipeStore(spark, path)
    return s.versions.where("applied_at is not null").select("version", "description", F.lit(s.version()).alias("latest"))


# exports and comparisons


_AB = (
    "WITH a AS (SELECT d.doc_id AS k, 't' || d.doc_id AS title, source AS book, quality = 1 AS o, toxic = 0 AS n, (d.doc_id % 97) / 97.0::DOUBLE AS c, "
    "CASE WHEN d.doc_id % 2 = 0 THEN 'structural_zones' ELSE 'original_with_patterns' END AS strategy FROM documents d JOIN labels l ON d.doc_id = l.doc_id) "
)


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").join(read_table(spark, sf_dir, "labels"), "doc_id")
    test = F.struct(
        (F.col("quality") == 1).alias("old_success"),
        (F.col("toxic") == 0).alias("new_success"),
        ((F.col("quality") == 1) == (F.col("toxic") == 0)).alias("agreement"),
        ((F.col("doc_id") % 97) / 97.0).alias("confidence"),
        F.when(F.col("doc_id") % 2 == 0, "structural_zones").otherwise("original_with_patterns").alias("strategy"),
    )
    return d.select(F.concat(F.lit("t"), "doc_id").alias("title"), F.col("source").alias("book"), F.to_json(F.struct(test.alias("ab_test"))).alias("metadata"))


@register(
    _AB + "SELECT title, CASE WHEN o = n THEN 'DEBUG' ELSE 'WARNING' END AS severity, CASE WHEN o = n THEN 'A/B AGREEMENT: both ' || CASE WHEN o THEN 'succeeded' ELSE 'failed' END ELSE "
    "printf('A/B DISAGREEMENT: old=%s, new=%s, confidence=%.2f', CASE WHEN o THEN 'True' ELSE 'False' END, CASE WHEN n THEN 'True' ELSE 'False' END, c) END AS message FROM a"
)
def ab_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.15-3: the messages of comparisons at the most talkative level."""
    return abtest.messages(_compared(spark, sf_dir), "DEBUG")


@register(
    _AB + ", d AS (SELECT *, row_number() OVER (ORDER BY c DESC, title, book) AS i FROM a WHERE o <> n), "
    "s AS (SELECT count(*) AS t, avg((o = n)::INT) * 100 AS g, avg(o::INT) * 100 AS os, avg(n::INT) * 100 AS ns, avg(c) AS ac FROM a), "
    "l AS (SELECT 1 AS line, repeat('=', 70) AS value UNION ALL SELECT 2, 'A/B TESTING REPORT' UNION ALL SELECT 7, 'Total tests:        ' || t FROM s UNION ALL SELECT 8, printf('%-20s%.1f%%', 'Agreement rate:', g) FROM s "
    "UNION ALL SELECT 9, printf('%-20s%.1f%%', 'Old success rate:', os) FROM s UNION ALL SELECT 10, printf('%-20s%.1f%%', 'New success rate:', ns) FROM s UNION ALL SELECT 11, printf('%-20s%.2f', 'Avg confidence:', ac) FROM s "
    "UNION ALL SELECT 13, 'DISAGREEMENTS (' || count(*) || ' cases)' FROM d UNION ALL SELECT 10 + 5 * i, i || '. ' || title FROM d WHERE i <= 10 UNION ALL SELECT 11 + 5 * i, '   Book: ' || book FROM d WHERE i <= 10 "
    "UNION ALL SELECT 12 + 5 * i, '   Old: ' || CASE WHEN o THEN 'SUCCESS' ELSE 'FAIL' END || ', New: ' || CASE WHEN n THEN 'SUCCESS' ELSE 'FAIL' END FROM d WHERE i <= 10 "
    "UNION ALL SELECT 13 + 5 * i, printf('   Confidence: %.2f, Strategy: %s', c, strategy) FROM d WHERE i <= 10) SELECT line::BIGINT AS line, value FROM l"
)
def ab_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK11, AGG3: the lines of the report that say something, by number."""
    lines = [(i, x) for i, x in enumerate(abtest.report(_compared(spark, sf_dir)).split("\n"), 1)]
    kept = [(i, x) for i, x in lines if i in (1, 2, *range(7, 12), 13) or (i > 14 and x and not x.startswith("="))]
    return spark.createDataFrame(kept, "line long, value string")


@register(
    "WITH r AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS i, count(*) OVER () AS n FROM part) SELECT i AS number, CASE WHEN i > 1 THEN ',' ELSE '' END || '{\"title\":\"' || p_name || '\",\"book\":\"' || p_brand || '\",\"serves\":' || "
    "CASE WHEN p_partkey % 2 = 0 THEN '\"' || p_size || '\"' ELSE 'null' END || ',\"tags\":[\"' || p_type || '\"],\"quality_score\":' || p_size || '}' AS value FROM r UNION ALL "
    "SELECT 0, '{\"metadata\": {\"count\": ' || count(*) || ', \"format_version\": \"1.0\"}, \"recipes\": [' FROM part UNION ALL SELECT count(*) + 1, ']}' FROM part"
)
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5, WIN6: a JSON document in parts."""
    r = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("book"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).alias("serves"), F.array("p_type").alias("tags"), F.col("p_size").alias("quality_score")
    )
    return export.export_json(r)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    k = F.col("p_partkey")
    return spread(read_table(spark, sf_dir, "part")).select(
        k.alias("id"), F.concat("p_name", F.lit(" "), k).alias("title"), F.col("p_brand").alias("book"), none.alias("author"), F.lit('Part "one"').alias("chapter"), F.concat(F.lit("1 cup of Hot Sauce(page "), k, F.lit(")")).alias("ingredients"), none.alias("instructions"), none.alias("notes"),
        F.col("p_size").cast("string").alias("serves"), none.alias("prep_time"), none.alias("cook_time"), F.when(k % 2 == 0, "grill").alias("cooking_method"), none.alias("protein_type"), F.col("p_size").alias("quality_score"), F.array("p_type").alias("tags"),
    )


_N = " || chr(10) || "


@register(
    "SELECT p_partkey AS id, " + _N.join(
        ["'---'", "'title: \"' || p_name || ' ' || p_partkey || '\"'", "'book: \"' || p_brand || '\"'", "'chapter: \"Part \\\"one\\\"\"'", "'tags:'", "'  - ' || p_type || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'cooking_method: \"grill\"' ELSE '' END",
         "'quality_score: ' || p_size", "'serves: \"' || p_size || '\"'", "'---'", "''", "'# ' || p_name || ' ' || p_partkey", "''", "'*From: Part \"one\"*'", "''", "'## Ingredients'", "''", "'1 cup of [[Hot Sauce]]'", "''", "'## Metadata'", "''",
         "'- **Quality Score:** ' || p_size || '/100'", "'- **Serves:** ' || p_size || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '- **Cooking Method:** grill' ELSE '' END", "'- **Book:** ' || p_brand"]
    ) + " AS content FROM part"
)
def vault_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK9, JOI8: whole pages."""
    return export.vault_pages(_pages(spark, sf_dir))


@register(
    "SELECT p_brand AS folder, count(*) AS files, min('# ' || p_name || ' ' || p_partkey) AS first_heading FROM part GROUP BY p_brand"
)
def export_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK7: the files a vault has on disk, read back."""
    folder = fresh_path(spark, "vault").removeprefix("file://")
    export.export_vault(_pages(spark, sf_dir), folder)
    found = export.vault_files(spark, folder)
    text = F.col("content").cast("string")
    book = F.regexp_extract(text, r'(?m)^book: "(.*)"$', 1)
    return found.groupBy(book.alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.min(F.regexp_extract(text, r"(?m)^(# .*)$", 1)).alias("first_heading"))


@register(
    "WITH b AS (SELECT p_brand AS v, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY p_brand), k AS (SELECT row_number() OVER (ORDER BY n DESC, f) AS i, v, n, count(*) OVER () AS all FROM b), "
    "t AS (SELECT count(*) AS t, avg(p_size) AS a, (SELECT count(*) FROM b) AS nb, count(*) FILTER (p_partkey % 2 = 0) AS g FROM part), "
    "l AS (SELECT 1 AS i, '# Recipe Vault' AS value UNION ALL SELECT 3, 'This vault holds ' || t || ' recipes.' FROM t UNION ALL SELECT 5, '## Export' UNION ALL SELECT 7, '- **Total Recipes:** ' || t FROM t UNION ALL SELECT 8, '- **Organization:** By book' "
    "UNION ALL SELECT 9, '- **Failed Exports:** 0' UNION ALL SELECT 11, '## Statistics' UNION ALL SELECT 13, printf('- **Average Quality Score:** %.1f/100', a) FROM t UNION ALL SELECT 14, '- **Number of Books:** ' || nb FROM t "
    "UNION ALL SELECT 15, '- **Cooking Methods:** 1' UNION ALL SELECT 17, '### Books' UNION ALL SELECT 18 + i, '- **' || v || ':** ' || n || ' recipes' FROM k UNION ALL SELECT 20 + nb, '### Cooking Methods' FROM t UNION ALL SELECT 22 + nb, '- **Grill:** ' || g || ' recipes' FROM t "
    "UNION ALL SELECT 24 + nb, '## Navigation' FROM t UNION ALL SELECT 26 + nb, '- Folders hold the recipes' FROM t UNION ALL SELECT 27 + nb, '- [[Recipe Name]] links lead from one recipe to another' FROM t UNION ALL SELECT 28 + nb, '- Tags are in the front matter' FROM t) "
    "SELECT i::BIGINT AS number, value FROM l"
)
def vault_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK8, AGG9: the lines of a vault's README but for blank ones."""
    rows = _pages(spark, sf_dir)
    n = rows.count()
    return export.vault_index(rows, "book", {"total": n, "success": n, "failed": 0, "duplicates": 0}).where("value <> ''")
