"""EPUB files to scored recipes: two Python passes over markup, everything else as native columns."""

from __future__ import annotations

import html as escaping
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from potluck.functions import metadata as meta
from potluck.functions import scoring
from potluck.functions.text import let, truthy
from potluck.functions.validate import is_valid_recipe
from potluck.operators import ingredients, instructions
from potluck.operators.abtest import compare
from potluck.operators.ingredients import legacy_ingredients
from potluck.operators.instructions import legacy_instructions
from potluck.operators.sections import clean_title, split_document
from potluck.operators.zones import ingredient_zones, instruction_zones, legacy_ingredient_zones, metadata_zones
from potluck.sources import epub
from potluck.sources.dom import VOID, Node, clean_lines, parse, release

from .config import DEFAULT, Components, Config

DOC_KEYS = "book string, author string, item_name string, item_ordinal int, chapter string"
SECTION = DOC_KEYS + ", section_ordinal int, title string, text string, markup string"
#: A document that cannot be split is one row without a text, and the failure.
SPLIT = SECTION + ", failure string"
ZONE = "struct<text: string, method: string, confidence: double>"
EXTRACTED = (
    DOC_KEYS + ", section_ordinal int, title string, text string, zone_text string, zone_method string, zone_confidence double, zone_count int, "
    f"legacy_ingredients string, legacy_instructions string, instruction_zones array<{ZONE}>, metadata_zone_text string, metadata_zone_count int, "
    "given_ingredients string, failure string"
)
#: Columns of a recipe, in the order of the stored table.
RECIPE = (
    "title book author chapter epub_section serves prep_time cook_time ingredients instructions notes cooking_method protein_type quality_score raw_content metadata tags"
).split()


def _columns(schema: str) -> list[str]:
    depth, names, part = 0, [], ""
    for ch in schema + ",":
        depth += ch in "<"
        depth -= ch in ">"
        if ch == "," and not depth:
            names.append(part.split()[0])
            part = ""
        else:
            part += ch
    return names


def to_markup(node: Node) -> str:
    out: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.tag != "[document]":
            out.append("<" + x.tag + "".join(f' {k}="{escaping.escape(a)}"' for k, a in x.attrs.items()) + ">")
            if x.tag in VOID:
                continue
            stack.append(f"</{x.tag}>")
        stack += [c if isinstance(c, Node) else escaping.escape(c, quote=False) for c in x.children[::-1]]
    return "".join(out)


#: Rows that leave a pass over markup together.
ROWS = 256


def framed(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of a few, so that a worker never holds what a whole batch of documents gives."""
    while part := list(islice(rows, ROWS)):
        yield pd.DataFrame(part, columns=names)


def _splitter(components: Components):
    read = components.parser or parse

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            for *keys, content in frame.itertuples(index=False):
                try:
                    tree = read(content if isinstance(content, str) else bytes(content))
                    found = split_document(tree)
                    made = [(*keys, i, clean_title(title), clean_lines(root), to_markup(root), None) for i, (title, root) in enumerate(found)]
                    release(tree, *(root for _, root in found))
                except Exception as e:  # noqa: BLE001  one bad document is no reason to lose the others
                    made = [(*keys, 0, None, None, None, f"{type(e).__name__}: {e}")]
                yield from made

    return lambda frames: framed(rows(frames), _columns(SPLIT))


def split_sections(documents: DataFrame, components: Components = DEFAULT) -> DataFrame:
    """Candidate sections of documents(book, author, item_name, item_ordinal, chapter, content); content may be text or bytes.

    A document on which the parser or the splitter fails is one row with its failure and no text.
    """
    rows = documents.where("content is not null").select("book", "author", "item_name", "item_ordinal", "chapter", "content")
    return rows.mapInPandas(_splitter(components), SPLIT)


def _text_of(found) -> str | None:
    """What an extractor found, with or without details."""
    return found[0] if isinstance(found, tuple) else found


def _extractor(components: Components):
    components = Components(ingredients=components.ingredients, instructions=components.instructions)  # what a worker needs; the others are columns

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            for *keys, text, markup in frame.itertuples(index=False):
                root = parse(markup)
                yield (*keys, text, *_parts(root, text or "", components))
                release(root)

    return lambda frames: framed(rows(frames), _columns(EXTRACTED))


def _parts(root: Node, text: str, components: Components) -> tuple:
    failures: list[str] = []

    def guarded(f, otherwise):
        try:
            return f()
        except Exception as e:  # noqa: BLE001  a section that breaks one strategy is left to the others
            failures.append(f"pattern_extraction_error: {e}")
            return otherwise

    zones = guarded(lambda: ingredient_zones(root), [])
    failed = failures[0] if failures else None
    meta_zones = guarded(lambda: metadata_zones(root), [])
    best = zones[0] if zones else None
    given = guarded(lambda: _text_of(components.ingredients(root, text)), None) if components.ingredients else None
    steps = components.instructions or (lambda root, text: legacy_instructions(root))
    return (
        best.node.glued("\n") if best else None,
        best.method if best else None,
        best.confidence if best else None,
        len(zones),
        guarded(lambda: legacy_ingredients(root, text), None),
        guarded(lambda: _text_of(steps(root, text)), None),
        guarded(lambda: [{"text": z.node.glued(), "method": z.method, "confidence": z.confidence} for z in instruction_zones(root)], []),
        " ".join(z.node.glued() for z in meta_zones),
        len(meta_zones),
        given,
        failed,
    )


def extract_parts(sections: DataFrame, components: Components = DEFAULT) -> DataFrame:
    """Zones and cascade results of sections; the texts to be scored, no scores yet. failure tells why ingredient zones could not be looked for."""
    return sections.select(*_columns(SECTION)).mapInPandas(_extractor(components), EXTRACTED)


def _sections_and_parts(components: Components, least: int):
    components = Components(parser=components.parser, ingredients=components.ingredients, instructions=components.instructions)

    names = _columns(EXTRACTED)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        read = components.parser or parse
        for frame in frames:
            for *keys, content in frame.itertuples(index=False):
                try:
                    tree = read(content if isinstance(content, str) else bytes(content))
                    found = [(i, clean_title(title), clean_lines(root), root) for i, (title, root) in enumerate(split_document(tree))]
                except Exception as e:  # noqa: BLE001  one bad document is no reason to lose the others
                    yield (*keys, 0, *[None] * (len(names) - len(keys) - 2), f"{type(e).__name__}: {e}")
                    continue
                for i, title, text, root in found:
                    if len(text) >= least:
                        yield (*keys, i, title, text, *_parts(root, text, components))
                release(tree, *(root for *_, root in found))

    return lambda frames: framed(rows(frames), names)


def sections_with_parts(documents: DataFrame, components: Components = DEFAULT, least: int = 0) -> DataFrame:
    """extract_parts over split_sections in one pass, so markup is parsed once; sections of fewer than `least` characters are left out."""
    rows = documents.where("content is not null").select("book", "author", "item_name", "item_ordinal", "chapter", "content")
    return rows.mapInPandas(_sections_and_parts(components, least), EXTRACTED)


ZONES = "kind string, ord int, node_pre int, method string, confidence double, field_hints array<string>, context map<string,string>, text string"


def zone_table(sections: DataFrame, *keys: str, markup_col: str = "markup") -> DataFrame:
    """Every zone of sections as a row, per key: kind (ingredients, legacy, instructions, metadata), place in the detector's order, method, confidence, hints, context and text."""
    schema = sections.select(*keys).schema
    finders = {"ingredients": ingredient_zones, "instructions": instruction_zones, "metadata": metadata_zones}

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            for *key, markup in frame.itertuples(index=False):
                root = parse(markup)
                for kind, f in finders.items():
                    yield from [(*key, kind, i, z.node.pre, z.method, z.confidence, z.hints, z.context, z.node.glued("\n")) for i, z in enumerate(f(root))]
                yield from [(*key, "legacy", i, n.pre, None, None, [], {}, n.glued("\n")) for i, n in enumerate(legacy_ingredient_zones(root))]
                release(root)

    find = lambda frames: framed(rows(frames), [*keys, *_columns(ZONES)])
    return sections.select(*keys, markup_col).mapInPandas(find, schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", " + ZONES)


def strategy_table(sections: DataFrame, *keys: str, markup_col: str = "markup") -> DataFrame:
    """What each strategy of the ingredient and instruction cascades gives by itself, and the whole cascades, as rows (kind, strategy, text); null where it finds nothing."""
    schema = sections.select(*keys).schema
    items = {"headed_lines": lambda r, t: ingredients.from_headed_lines(t), "line_runs": lambda r, t: ingredients.from_runs(t)}
    items |= {"lists": lambda r, t: ingredients.from_lists(r), "paragraph_classes": lambda r, t: ingredients.from_paragraph_classes(r)}
    items |= {"paragraph_runs": lambda r, t: ingredients.from_paragraph_runs(r), "cascade": lambda r, t: legacy_ingredients(r, "\n".join(t))}
    steps = {f.__name__: f for f in instructions.CASCADE} | {"cascade": legacy_instructions}

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            for *key, markup in frame.itertuples(index=False):
                root = parse(markup)
                lines = clean_lines(root).split("\n")
                yield from [(*key, "ingredients", n, f(root, lines)) for n, f in items.items()]
                yield from [(*key, "instructions", n, f(root)) for n, f in steps.items()]
                release(root)

    find = lambda frames: framed(rows(frames), [*keys, "kind", "strategy", "text"])
    return sections.select(*keys, markup_col).mapInPandas(find, schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", kind string, strategy string, text string")


def ingredients_with_patterns(zone_text: Column, zone_method: Column, zone_confidence: Column, zone_count: Column, legacy: Column, failure: Column | None = None) -> Column:
    """ING11: the best zone if its weighted score is 0.5 or more, else the cascade's text; a struct (text, details).

    ING1: where looking for zones failed, the cascade's text with strategy legacy_fallback and a confidence of 0.5.
    """
    reason = F.lit(None).cast("string") if failure is None else failure

    def scored(x: Column) -> Column:
        return F.struct(scoring.ingredient_confidence(x).alias("pattern"), scoring.ingredient_linguistic(x).alias("linguistic"))

    def one(s: Column) -> Column:
        usable = (zone_count > 0) & (F.length(F.coalesce(zone_text, F.lit(""))) > 50)
        structural = zone_confidence * 0.30 + s["zone"]["pattern"] * 0.50 + s["zone"]["linguistic"] * 0.20
        by_zone = F.coalesce(usable & (structural >= 0.5), F.lit(False))
        by_legacy = ~by_zone & truthy(legacy)
        fallback = reason.isNotNull() & truthy(legacy)
        sure = F.when(reason.isNull(), F.lit(True))  # null where zones were not looked at

        def choose(zone, old, none, failed) -> Column:
            return F.when(fallback, failed).when(reason.isNotNull(), F.lit(None)).when(by_zone, zone).when(by_legacy, old).when(usable, zone).otherwise(none)

        return F.struct(
            F.when(by_zone, zone_text).when(truthy(legacy), legacy).alias("text"),
            F.struct(
                choose(F.lit("structural_zones"), F.lit("original_with_patterns"), F.lit(None).cast("string"), F.lit("legacy_fallback")).alias("strategy"),
                choose(s["zone"]["pattern"], s["old"]["pattern"], F.lit(0.0), F.lit(0.5)).alias("confidence"),
                choose(s["zone"]["linguistic"], s["old"]["linguistic"], F.lit(0.0), F.lit(0.0)).alias("linguistic_score"),
                F.when(sure, F.when(zone_count > 0, zone_confidence).otherwise(0.0)).alias("structural_confidence"),
                F.when(sure, zone_count > 0).alias("used_structural_detector"),
                F.when(sure, zone_count).alias("zone_count"),
                choose(structural, s["old"]["pattern"] * 0.70 + s["old"]["linguistic"] * 0.30, F.lit(0.0), F.lit(0.5)).alias("combined_score"),
                F.when(usable, zone_method).alias("detection_method"),
                F.when(fallback, reason).alias("fallback_reason"),
            ).alias("details"),
        )

    return let(F.struct(scored(zone_text).alias("zone"), scored(legacy).alias("old")), one)


def instructions_with_patterns(zones: Column, legacy: Column) -> Column:
    """INS12: the zone with the greatest weighted score if it is 0.5 or more (the first of equal ones), else the cascade's text."""

    def scored(z: Column, i: Column) -> Column:
        p, k = scoring.instruction_confidence(z["text"]), scoring.instruction_linguistic(z["text"])
        return let(
            F.struct(p.alias("pattern"), k.alias("linguistic")),
            lambda s: F.struct(
                (z["confidence"] * 0.30 + s["pattern"] * 0.50 + s["linguistic"] * 0.20).alias("combined"),
                (-i).alias("place"),
                s["pattern"].alias("pattern"),
                s["linguistic"].alias("linguistic"),
                z["method"].alias("method"),
                z["text"].alias("text"),
            ),
        )

    ranked = F.filter(F.transform(zones, scored), lambda s: (F.length(s["text"]) >= 50) & (s["combined"] > 0))

    def one(best: Column) -> Column:
        by_zone = F.coalesce(best["combined"] >= 0.5, F.lit(False))
        by_legacy = ~by_zone & truthy(legacy)
        old = F.struct(scoring.instruction_confidence(legacy).alias("pattern"), scoring.instruction_linguistic(legacy).alias("linguistic"))
        return let(
            old,
            lambda o: F.struct(
                F.when(by_zone, best["text"]).when(truthy(legacy), legacy).alias("text"),
                F.struct(
                    F.when(by_legacy, "original_with_patterns").when(best.isNotNull(), F.concat(F.lit("structural_"), best["method"])).alias("strategy"),
                    F.when(by_legacy, o["pattern"]).otherwise(F.coalesce(best["pattern"], F.lit(0.0))).alias("confidence"),
                    F.when(by_legacy, o["linguistic"]).otherwise(F.coalesce(best["linguistic"], F.lit(0.0))).alias("linguistic_score"),
                    (F.size(zones) > 0).alias("used_structural_detector"),
                    F.size(zones).alias("zone_count"),
                    best["method"].alias("detection_method"),
                ).alias("details"),
            ),
        )

    return let(F.array_max(ranked), one)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once per row: filters on it are not pushed below it, where they would compute it again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _assemble(parts: DataFrame, config: Config) -> DataFrame:
    use = config.components
    pattern = ingredients_with_patterns(F.col("zone_text"), F.col("zone_method"), F.col("zone_confidence"), F.col("zone_count"), F.col("legacy_ingredients"), F.col("failure"))
    df = _once(parts, "__p", pattern)
    if use.ingredients:
        ingredients, details = F.col("given_ingredients"), F.lit(None)
    elif config.extraction.use_pattern_extraction:
        ingredients, details = F.col("__p.text"), F.col("__p.details")
    else:
        ingredients, details = F.col("legacy_ingredients"), F.lit(None)
    df = df.withColumn("ingredients", ingredients)
    fields = []
    if config.ab_testing.enabled:
        df = df.withColumn("ab_test", compare(F.col("ingredients"), F.col("__p.text"), F.col("__p.details"), config.ab_testing.success_threshold))
        if config.ab_testing.use_new_method:
            df = df.withColumn("ingredients", F.coalesce("ab_test.new_ingredients", "ingredients"))
        fields.append(F.col("ab_test"))
    if config.extraction.use_pattern_extraction and not use.ingredients:
        fields.insert(0, F.struct(details.alias("ingredients")).alias("extraction"))
    df = df.withColumn("metadata", F.to_json(F.struct(*fields)) if fields else F.lit(None).cast("string")).withColumn("instructions", F.col("legacy_instructions"))
    df = (
        _once(df, "__m", (use.metadata or meta.extract_metadata)(F.col("text"), F.col("title")))
        .select("*", *[F.col(f"__m.{n}").alias(n) for n in meta.FIELDS])
        .withColumn("raw_content", F.col("text") if config.extraction.include_raw_content else F.lit(None).cast("string"))
        .withColumn("epub_section", F.col("item_name"))
        .withColumn("notes", F.lit(None).cast("string"))
        .withColumn("tags", F.array().cast("array<string>"))
    )
    score = (use.scorer or scoring.quality)(*[F.col(c) for c in ("ingredients", "instructions", *meta.FIELDS)]).cast("int")
    return _once(df, "quality_score", score).where(F.col("quality_score") >= (config.extraction.min_quality_score or 0))


def extract_from_documents(documents: DataFrame, config: Config | None = None) -> DataFrame:
    """Recipes of documents: sections of 100 characters or more that look like a recipe and have ingredients, scored and thresholded."""
    config = config or Config()
    use = config.components
    valid = (use.validator or is_valid_recipe)(F.col("text"), F.col("title"))
    if config.stages:
        # stages see the sections before anything is extracted from them
        parts = extract_parts(config.apply(split_sections(documents, use).where(F.length("text") >= 100).where(valid)), use)
    else:
        parts = sections_with_parts(documents, use, 100).where(F.length("text") >= 100).where(valid)
    recipes = _assemble(parts, config).where(truthy(F.col("ingredients")))
    return recipes.select(*RECIPE, "item_ordinal", "section_ordinal")


def extract_from_section(sections: DataFrame, config: Config | None = None) -> DataFrame:
    """SRC11: sections(title, book, author, markup) each taken as one recipe; no length test, rows without ingredients stay."""
    config = config or Config()

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for title, book, author, markup in frame.itertuples(index=False):
                root = read(markup)
                rows.append((book, author, None, 0, None, 0, title, clean_lines(root), to_markup(root)))
            yield pd.DataFrame(rows, columns=_columns(SECTION))

    use = config.components
    read = use.parser or parse
    found = sections.select("title", "book", "author", "markup").mapInPandas(whole, SECTION).where((use.validator or is_valid_recipe)(F.col("text"), F.col("title")))
    return _assemble(extract_parts(config.apply(found), use), config).select(*RECIPE)


def extract_recipes(spark: SparkSession, path: str, config: Config | None = None, pattern: str = "*.epub") -> DataFrame:
    """Recipes of one EPUB file or of a folder's files. A single unreadable file raises ValueError; in a folder it is skipped (see batch)."""
    documents = epub.read_documents(epub.scan_files(spark, path, pattern))
    if path.lower().endswith(".epub"):
        if epub.is_folder(spark, path):
            raise ValueError(f"no file: {path}")
        bad = documents.where("error is not null").select("error").head()
        if bad is not None:
            raise ValueError(f"no readable EPUB: {path}: {bad['error']}")
    return extract_from_documents(documents, config)


def batch(spark: SparkSession, folder: str, config: Config | None = None, pattern: str = "*.epub") -> tuple[DataFrame, DataFrame]:
    """(recipes, files) of a folder; files has path, book and error, null where the file was read."""
    documents = epub.read_documents(epub.scan_files(spark, folder, pattern))
    files = documents.groupBy("path").agg(F.max("book").alias("book"), F.max("error").alias("error"))
    return extract_from_documents(documents, config), files
