"""Predicates on sections, titles and lines (FIL2 to FIL5, FIL8, ING6, ING7, ING9, INS7, INS10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as v
from .text import any_of, let, matches, search, strip, whole_words

WORD_START = r"(?U)\s+"


def is_sub_section(title: Column) -> Column:
    return search(title, v.SUB_SECTION)


def is_ingredient_title(title: Column) -> Column:
    """A quantity with a unit, or a short title with a digit, a single ingredient or a measurement."""
    low, n = F.lower(title), F.length(title)
    single = low.isin(v.SINGLE_INGREDIENTS) | low.rlike("^(?:" + "|".join(v.SINGLE_INGREDIENTS) + ") ")
    return (
        F.when(search(title, v.QUANTITY_TITLE), True)
        .when(n > 40, False)
        .when((n < 20) & (title.rlike(r"(?U)\d") | single), True)
        .otherwise((n < 30) & search(title, v.MEASUREMENT))
    )


def has_excluded_word(title: Column) -> Column:
    return any_of(F.lower(title), v.EXCLUDED)


def recipe_points(text: Column) -> Column:
    """0 to 10: verbs 3, measurements 2, two key words 2 each, length 1."""
    return let(
        F.lower(text),
        lambda low: F.when(whole_words(low, v.COOKING_VERBS) >= 3, 3).otherwise(0)
        + F.when(matches(low, v.MEASUREMENT) >= 2, 2).otherwise(0)
        + F.when(search(low, r"\b(?:what you need|ingredient)\b"), 2).otherwise(0)
        + F.when(search(low, r"\b(?:direction|instruction|method|steps?)\b"), 2).otherwise(0)
        + F.when(F.length(text) > 200, 1).otherwise(0),
    )


def is_valid_recipe(text: Column, title: Column) -> Column:
    """FIL2: the title names no part, excluded section or ingredient, and the text has 5 points."""
    t = F.coalesce(title, F.lit(""))
    bare = strip(t)
    return ~is_sub_section(bare) & ~has_excluded_word(t) & ~is_ingredient_title(bare) & (recipe_points(F.coalesce(text, F.lit(""))) >= 5)


def is_likely_recipe_title(title: Column) -> Column:
    """FIL8, for entries of a table of contents."""
    low = F.lower(title)
    bad = low.rlike(r"(?U)^(?:chapter|part)\s+\d+") | any_of(low, v.EXCLUDED) | (F.length(title) < 3) | strip(title).rlike(r"(?U)^\d+$")
    return F.coalesce(~bad & (any_of(low, v.TOC_FOODS) | (F.length(title) > 10)), F.lit(False))


def first_word(line: Column) -> Column:
    return F.rtrim(F.lower(F.element_at(F.split(strip(line), WORD_START), 1)), F.lit(",.:;"))


def is_ingredient_header(line: Column) -> Column:
    n = F.length(line)
    return (n > 0) & (n <= 60) & any_of(F.lower(line), v.TEXT_INGREDIENT_KEYWORDS) & ~search(line, v.MEASUREMENT)


def is_ingredient_line(line: Column) -> Column:
    return F.length(line).between(5, 150) & search(line, v.MEASUREMENT) & ~first_word(line).isin(v.LINE_VERBS)


def is_instruction_line(line: Column) -> Column:
    return (F.length(line) >= 10) & ((F.length(line) > 100) | first_word(line).isin(v.LINE_VERBS))


def is_loose_ingredient(line: Column) -> Column:
    low = F.lower(line)
    return F.length(line).between(3, 150) & (search(low, v.LOOSE_INGREDIENT) | (line.rlike(r"(?U)^\d") & any_of(low, v.LOOSE_FOODS)))


def is_stop_line(line: Column) -> Column:
    return strip(F.lower(line)).rlike("(?U)" + v.STOP_LINE)


def is_ingredient_item(line: Column) -> Column:
    """INS10: short, with a measurement and at most one verb."""
    return (F.length(line) < 50) & search(line, v.MEASUREMENT) & (whole_words(F.lower(line), v.COOKING_VERBS) <= 1)

