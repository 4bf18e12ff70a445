"""Extraction details: how a component was found, kept as JSON beside a recipe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scoring
from .text import lines, truthy


def extraction_confidence(metadata: Column, component: str) -> Column:
    """The confidence kept for a component, null without one."""
    return F.get_json_object(metadata, f"$.extraction.{component}.confidence").try_cast("double")


def extraction_strategy(metadata: Column, component: str) -> Column:
    return F.get_json_object(metadata, f"$.extraction.{component}.strategy")


def merge_extraction(metadata: Column, details: Column, component: str) -> Column:
    """metadata, a JSON object or null, with details (JSON) under extraction.component; unchanged where details are null or {}."""
    base = F.coalesce(F.from_json(metadata, "map<string,string>"), F.create_map().cast("map<string,string>"))
    old = F.coalesce(F.from_json(F.element_at(base, "extraction"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: k != component)
    inner = _object(F.map_concat(kept, F.create_map(F.lit(component), details)))
    outer = _object(F.map_concat(F.map_filter(base, lambda k, _: k != "extraction"), F.create_map(F.lit("extraction"), inner)))
    return F.when(truthy(details) & (details != "{}"), outer).otherwise(metadata)


def _object(m: Column) -> Column:
    """A JSON object of a map from names to JSON values. Values that are no JSON by themselves are quoted."""

    def value(x: Column) -> Column:
        json = x.rlike(r'^(?:\{.*\}|\[.*\]|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)$')
        return F.when(x.isNull(), "null").when(json, x).otherwise(F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))

    parts = F.transform(F.map_entries(m), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), value(e["value"])))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def with_confidence(text: Column) -> Column:
    """SCO12: a struct of the text, its confidence, the six components and the number of lines; zeros for an empty text."""
    some = truthy(text)
    return F.struct(
        F.when(some, text).alias("text"),
        scoring.ingredient_confidence(text).alias("confidence"),
        F.when(some, scoring.ingredient_components(text)).alias("components"),
        F.when(some, F.size(lines(text))).otherwise(0).alias("line_count"),
    )


def normalize_whitespace(text: Column) -> Column:
    """DOM9: every line stripped, blank ones left out."""
    return F.array_join(lines(text), "\n")
