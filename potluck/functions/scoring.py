"""Scores of recipe texts as pure Column functions (SCO1 to SCO42)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as v
from .text import any_of, clamp, count_if, hits, let, lines, literals, search, sentences, share, steps, strip, total, trailing_share, truthy, whole_words, words


def _guard(text: Column, least: int, body: Callable[[Column], Column]) -> Column:
    """0 for a text that is null or shorter than `least` once stripped."""
    return F.when(F.length(strip(F.coalesce(text, F.lit("")))) >= least, body(text)).otherwise(F.lit(0.0))


# quality: SCO1-3


def ingredient_points(text: Column) -> Column:
    """0 to 45 by length, structured lines, number of lines and a measurement."""
    length = steps(F.length(text), [(300, 15), (200, 12), (100, 9), (50, 6)], 3)

    def by_lines(ls: Column) -> Column:
        ratio = share(count_if(ls, lambda x: x.rlike(r"(?U)^[-*\d]+[.)]\s")), F.size(ls))
        long = count_if(ls, lambda x: F.length(x) > 5)
        return steps(ratio, [(0.7, 15), (0.4, 10), (0.2, 5)], 0) + steps(long, [(10, 10), (7, 8), (5, 6), (3, 4), (1, 2)], 0)

    points = length + let(lines(text), by_lines) + F.when(search(text, v.SCORE_MEASUREMENT), 5).otherwise(0)
    return F.when(truthy(text), F.least(points, F.lit(45))).otherwise(0)


def instruction_points(text: Column) -> Column:
    """0 to 45 by length, numbered lines, distinct verbs and sentence ends."""
    length = steps(F.length(text), [(500, 15), (300, 12), (200, 9), (100, 6)], 3)
    numbered = count_if(lines(text), lambda x: x.rlike(r"(?U)^\d+[.)]\s"))
    verbs = let(F.lower(text), lambda t: hits(t, v.SCORE_VERBS))
    ends = F.length(text) - F.length(F.translate(text, ".!?", ""))
    points = (
        length
        + steps(numbered, [(5, 15), (3, 12), (2, 8)], 0)
        + steps(verbs, [(8, 10), (5, 8), (3, 5), (1, 3)], 0)
        + steps(ends, [(5, 5), (3, 3), (1, 1)], 0)
    )
    return F.when(truthy(text), F.least(points, F.lit(45))).otherwise(0)


def quality(
    ingredients: Column, instructions: Column, serves: Column, prep: Column, cook: Column, method: Column, protein: Column, have: Column | None = None, does: Column | None = None
) -> Column:
    """0 to 100: both parts, up to 10 for metadata, minus 40 for each part that is missing. `have` and `does` are the parts' points where they are known."""
    meta = sum(
        (F.when(truthy(c), n).otherwise(0) for c, n in ((serves, 3), (prep, 2), (cook, 2), (method, 2), (protein, 1))), F.lit(0)
    )
    missing = F.when(F.length(strip(F.coalesce(ingredients, F.lit("")))) < 10, 40).otherwise(0) + F.when(
        F.length(strip(F.coalesce(instructions, F.lit("")))) < 20, 40
    ).otherwise(0)
    have = ingredient_points(ingredients) if have is None else have
    does = instruction_points(instructions) if does is None else does
    points = have + does + F.least(meta, F.lit(10))
    return F.least(F.greatest(points - missing, F.lit(0)), F.lit(100)).cast("int")


def validator_confidence(text: Column, ingredients: Column, instructions: Column) -> Column:
    """SCO4."""
    n = lambda c: F.coalesce(F.length(c), F.lit(0))
    over = lambda c, cuts: steps(n(c), [(k + 1, w) for k, w in cuts], 0.0)
    both = F.when(truthy(ingredients) & truthy(instructions), 0.2).otherwise(0.0)
    return F.least(
        over(text, [(500, 0.2), (200, 0.1)]) + over(ingredients, [(200, 0.3), (100, 0.2), (50, 0.1)]) + over(instructions, [(300, 0.3), (150, 0.2), (100, 0.1)]) + both,
        F.lit(1.0),
    )


# ingredient patterns: SCO5-12


def measurement_lines(ls: Column) -> Column:
    ratio = share(count_if(ls, lambda x: search(x, v.UNIT_LINE) | x.rlike("(?U)" + v.FRACTION)), F.size(ls))
    return let(ratio, lambda r: steps(r, [(0.7, 1.0), (0.5, 0.85), (0.3, 0.65), (0.15, 0.4)], r * 2))


def noun_density(low: Column) -> Column:
    return let(share(hits(low, v.NOUNS), F.length(low)) * 100, lambda d: steps(d, [(3.0, 1.0), (2.0, 0.85), (1.0, 0.65), (0.5, 0.45)], d))


def descriptor_density(low: Column) -> Column:
    return let(share(hits(low, v.DESCRIPTORS), F.length(low)) * 100, lambda d: steps(d, [(2.0, 1.0), (1.0, 0.75), (0.5, 0.5)], d * 0.5))


def _mean_length(ls: Column) -> Column:
    return total(F.transform(ls, F.length)) / F.size(ls)


def list_structure(ls: Column) -> Column:
    markers = share(count_if(ls, lambda x: x.rlike("(?U)" + v.LIST_MARKER)), F.size(ls))

    def spread(mean: Column) -> Column:
        return F.aggregate(ls, F.lit(0.0), lambda a, x: a + F.abs(F.length(x) - mean)) / F.size(ls)

    even = F.lit(1.0) - F.least(let(_mean_length(ls), spread) / 50, F.lit(1.0))
    return F.when(F.size(ls) < 3, 0.0).otherwise(F.least(markers * 0.6 + even * 0.4, F.lit(1.0)))


def line_lengths(ls: Column) -> Column:
    ratio = share(count_if(ls, lambda x: F.length(x).between(20, 100)), F.size(ls))
    by_mean = let(_mean_length(ls), lambda m: F.when(m.between(40, 70), 1.0).when(m.between(30, 80), 0.75).otherwise(0.5))
    return F.when(F.size(ls) == 0, 0.0).otherwise(ratio * 0.6 + by_mean * 0.4)


def verb_penalty(low: Column) -> Column:
    n = total(F.transform(literals([f" {w} " for w in v.INGREDIENT_VERBS]), lambda w: _occurrences(low, w).cast("long")))
    return let(n, lambda k: F.when(k == 0, 1.0).when(k == 1, 0.75).when(k == 2, 0.5).when(k == 3, 0.25).otherwise(0.0))


def _occurrences(c: Column, part: Column) -> Column:
    return ((F.length(c) - F.length(F.replace(c, part, F.lit("")))) / F.length(part)).cast("int")


def ingredient_components(text: Column) -> Column:
    """The six components as a struct (SCO12)."""
    return let(
        F.struct(F.lower(text).alias("low"), lines(text).alias("ls")),
        lambda s: F.struct(
            measurement_lines(s["ls"]).alias("measurement"),
            noun_density(s["low"]).alias("nouns"),
            descriptor_density(s["low"]).alias("descriptors"),
            list_structure(s["ls"]).alias("list_structure"),
            line_lengths(s["ls"]).alias("line_length"),
            verb_penalty(s["low"]).alias("verb_absence"),
            F.size(s["ls"]).alias("line_count"),
        ),
    )


def ingredient_confidence(text: Column) -> Column:
    def mix(c: Column) -> Column:
        return clamp(
            c["measurement"] * 0.30 + c["nouns"] * 0.25 + c["descriptors"] * 0.15 + c["list_structure"] * 0.15 + c["line_length"] * 0.10 + c["verb_absence"] * 0.05
        )

    return _guard(text, 10, lambda t: let(ingredient_components(t), mix))


# instruction patterns: SCO13-18


def verb_density(low: Column) -> Column:
    density = share(whole_words(low, v.COOKING_VERBS), F.size(words(low))) * 100
    return let(
        density,
        lambda d: F.when(d.between(10, 40), 1.0)
        .when((d >= 5) & (d < 10), (d - 5) / 5)
        .when((d > 40) & (d <= 60), F.lit(1.0) - (d - 40) / 20)
        .when(d >= 60, 0.3)
        .otherwise(0.0),
    )


def marker_score(low: Column) -> Column:
    return F.least(hits(low, sorted({*v.TEMPORAL, *v.SEQUENTIAL})) / F.lit(3.0), F.lit(1.0))


def imperative_share(low: Column) -> Column:
    def one(ss: Column) -> Column:
        return share(count_if(ss, lambda s: F.rtrim(F.element_at(F.split(s, r"(?U)\s+"), 1), F.lit(",.:;")).isin(v.IMPERATIVES)), F.size(ss))

    return let(sentences(low), one)


def paragraph_length(text: Column) -> Column:
    n = F.length(text)
    return (
        F.when(n.between(100, 500), 1.0).when((n >= 50) & (n < 100), (n - 50) / 50.0).when((n > 500) & (n <= 1000), F.lit(1.0) - (n - 500) / 500.0).otherwise(0.0)
    )


def measurement_penalty(text: Column) -> Column:
    def one(ls: Column) -> Column:
        ratio = share(count_if(ls, lambda x: search(x, v.MEASUREMENT)), F.size(ls))
        return let(ratio, lambda r: F.when(r < 0.2, 1.0).when(r > 0.5, 0.0).otherwise(F.lit(1.0) - (r - 0.2) / 0.3))

    return let(lines(text), one)


def instruction_confidence(text: Column) -> Column:
    return _guard(
        text,
        10,
        lambda t: let(
            F.lower(t),
            lambda low: clamp(
                verb_density(low) * 0.30 + marker_score(low) * 0.25 + imperative_share(low) * 0.20 + paragraph_length(t) * 0.15 + measurement_penalty(t) * 0.10
            ),
        ),
    )


# metadata patterns: SCO19-24, over lower-cased text


def _short(low: Column, lo: int, hi: int) -> Column:
    return F.when(F.length(low).between(lo, hi), 0.1).otherwise(0.0)


def servings_confidence(low: Column) -> Column:
    return F.least(
        F.least(hits(low, v.SERVING_WORDS) / F.lit(2.0), F.lit(1.0)) * 0.4
        + F.when(search(low, v.SERVING_NUMBER), 0.3).when(search(low, v.SERVES), 0.2).otherwise(0.0)
        + F.when(low.rlike(r"(?U)\b\d+\b"), 0.2).otherwise(0.0)
        + _short(low, 5, 50),
        F.lit(1.0),
    )


def time_confidence(low: Column) -> Column:
    unit = search(low, v.TIME_UNIT)
    return F.least(
        F.least(hits(low, v.TIME_WORDS) / F.lit(2.0), F.lit(1.0)) * 0.4
        + F.when(search(low, v.PREP_TIME) | search(low, v.COOK_TIME), 0.3).when(unit, 0.15).otherwise(0.0)
        + F.when(low.rlike(r"(?U)\b\d+\b") & unit, 0.2).otherwise(0.0)
        + _short(low, 5, 60),
        F.lit(1.0),
    )


def method_confidence(low: Column) -> Column:
    found = sum((F.when(any_of(low, ws), 1).otherwise(0) for _, ws in v.METHODS), F.lit(0))
    score = (
        F.least(F.lit(0.7), found * F.lit(0.35))
        + F.when(F.length(low) < 100, 0.2).otherwise(0.0)
        - F.when((F.length(low) > 200) | any_of(low, v.METHOD_UNITS), 0.1).otherwise(0.0)
    )
    return clamp(score)


def protein_confidence(low: Column) -> Column:
    kinds = let(hits(low, v.PROTEINS), lambda n: F.when(n == 1, 0.7).when(n > 1, 0.4).otherwise(0.0))
    return F.least(
        kinds + F.when(F.length(low) < 100, 0.2).otherwise(0.0) + F.when(any_of(low, v.PROTEIN_CONTEXT), 0.1).otherwise(0.0),
        F.lit(1.0),
    )


def difficulty_confidence(low: Column) -> Column:
    n = hits(low, [w for w, _ in v.DIFFICULTY])
    return F.least(
        F.least(F.lit(0.6), n * F.lit(0.3)) + F.when(F.length(low) < 80, 0.3).otherwise(0.0) + F.when(any_of(low, v.DIFFICULTY_CONTEXT), 0.1).otherwise(0.0),
        F.lit(1.0),
    )


FIELD_CONFIDENCE = {
    "servings": servings_confidence,
    "time": time_confidence,
    "method": method_confidence,
    "protein": protein_confidence,
    "difficulty": difficulty_confidence,
}


def field_confidence(text: Column, field: str) -> Column:
    """SCO19: by kind of field; an unknown kind scores 0."""
    score = FIELD_CONFIDENCE.get(field)
    return F.lit(0.0) if score is None else _guard(text, 3, lambda t: let(F.lower(t), score))


# linguistic scores: SCO25-41


def legacy_linguistic(text: Column) -> Column:
    """Case-sensitive on purpose."""

    def one(ls: Column) -> Column:
        n = F.size(ls)
        mean = _mean_length(ls)
        score = (
            F.when(share(count_if(ls, lambda x: any_of(x, v.LEGACY_LINE_VERBS)), n) > 0.5, -0.3).otherwise(0.0)
            + share(count_if(ls, lambda x: any_of(x, v.LEGACY_DESCRIPTORS)), n) * 0.4
            + let(mean, lambda m: F.when(m.between(20, 80), 0.3).when(m > 150, -0.2).otherwise(0.0))
            + share(count_if(ls, lambda x: x.rlike(r"(?U)^[\d•\-*]\s*\w+")), n) * 0.3
        )
        return clamp(score + 0.5)

    return _guard(text, 10, lambda t: let(lines(t), one))


def _falling(x: Column, lo: float, hi: float, end: float, slope: float, below: Column) -> Column:
    """1 within lo..hi, `below` under it, falling by 1/slope up to end, then 0."""
    return F.when(x.between(lo, hi), 1.0).when(x < lo, below).when((x > hi) & (x <= end), F.lit(1.0) - (x - hi) / slope).otherwise(0.0)


MARKS = ",.;:!?"


def _split(low: Column, ws: Column | None) -> Column:
    """The words of low, unless the caller has them."""
    return words(low) if ws is None else ws


def _per_words(low: Column, ws: Column | None, entries: list[str], per: int, marks: str = MARKS) -> Column:
    return let(_split(low, ws), lambda x: trailing_share(x, entries, marks)) * per


def verb_presence(low: Column, ws: Column | None = None) -> Column:
    return let(_per_words(low, ws, v.LING_VERBS, 100), lambda f: _falling(f, 2, 8, 12, 8.0, f / 2))


def temporal_score(low: Column) -> Column:
    return F.least(hits(low, v.LING_TEMPORAL) / F.lit(2.0), F.lit(1.0))


def sentence_structure(text: Column) -> Column:
    def one(ss: Column) -> Column:
        return F.when(F.size(ss) == 0, 0.0).otherwise(
            let(_mean_length(ss), lambda m: _falling(m, 40, 150, 250, 100.0, F.when(m >= 20, (m - 20) / 20).otherwise(0.0)))
        )

    return let(sentences(text), one)


def stop_score(low: Column) -> Column:
    starts = let(strip(low), lambda t: F.exists(literals(v.LING_STOPS), lambda w: F.startswith(t, w)))
    found = let(hits(low, v.LING_STOPS), lambda n: F.when(n == 0, 1.0).when(n == 1, 0.5).otherwise(0.0))
    return F.when(starts, 0.0).otherwise(found)


def instruction_linguistic(text: Column) -> Column:
    return _guard(
        text,
        10,
        lambda t: let(F.lower(t), lambda low: clamp(verb_presence(low) * 0.4 + temporal_score(low) * 0.3 + sentence_structure(t) * 0.2 + stop_score(low) * 0.1)),
    )


def keyword_presence(low: Column, ws: Column | None = None) -> Column:
    return let(_per_words(low, ws, v.META_WORDS, 10), lambda f: _falling(f, 1, 3, 5, 4.0, f))


def numeric_score(low: Column) -> Column:
    digits = let(F.regexp_count(low, F.lit(r"(?U)\d")), lambda n: F.when(n > 8, 0.2).when(n >= 1, 0.4).otherwise(0.0))
    return F.least(
        digits
        + F.when(search(low, v.TIME_UNIT), 0.3).otherwise(0.0)
        + F.when(low.rlike(r"(?U)\d\s*[-to]\s*\d"), 0.3).otherwise(0.0),
        F.lit(1.0),
    )


def conciseness(text: Column) -> Column:
    n = F.length(text)
    return _falling(n, 5, 100, 200, 100.0, n / 5.0)


def narrative_absence(low: Column, ws: Column | None = None) -> Column:
    return let(_per_words(low, ws, v.NARRATIVE, 1), lambda r: F.when(r < 0.1, 1.0).when(r < 0.3, F.lit(1.0) - (r - 0.1) / 0.2).otherwise(0.0))


def metadata_linguistic(text: Column) -> Column:
    return _guard(
        text,
        3,
        lambda t: let(
            F.lower(t),
            lambda low: let(
                words(low), lambda ws: clamp(keyword_presence(low, ws) * 0.35 + numeric_score(low) * 0.30 + conciseness(t) * 0.20 + narrative_absence(low, ws) * 0.15)
            ),
        ),
    )


def descriptor_presence(low: Column, ws: Column | None = None) -> Column:
    return let(_per_words(low, ws, v.LING_DESCRIPTORS, 20), lambda f: _falling(f, 1, 4, 6, 4.0, f))


def unit_presence(low: Column, ws: Column | None = None) -> Column:
    return let(_per_words(low, ws, v.LING_UNITS, 10, MARKS + "s"), lambda f: _falling(f, 0.5, 3, 5, 4.0, f / 0.5))


def line_structure(ls: Column) -> Column:
    n = F.size(ls)
    score = (
        share(count_if(ls, lambda x: F.length(x).between(20, 100)), n) * 0.4
        + share(count_if(ls, lambda x: x.rlike("(?U)" + v.LING_MARKER)), n) * 0.3
        + F.when(n >= 3, 0.3).when(n == 2, 0.15).otherwise(0.0)
    )
    return F.least(score, F.lit(1.0))


def noun_presence(low: Column) -> Column:
    density = share(hits(low, v.LING_NOUNS), F.length(low)) * 100
    return let(density, lambda d: steps(d, [(2.0, 1.0), (1.0, 0.75), (0.5, 0.5)], d))


def verb_absence(low: Column) -> Column:
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    return let(padded, lambda p: let(hits(p, [f" {w} " for w in v.INGREDIENT_VERBS]), lambda n: F.when(n == 0, 1.0).when(n == 1, 0.6).when(n == 2, 0.3).otherwise(0.0)))


def ingredient_linguistic(text: Column) -> Column:
    def one(low: Column, ws: Column, ls: Column) -> Column:
        return clamp(
            descriptor_presence(low, ws) * 0.30 + unit_presence(low, ws) * 0.25 + line_structure(ls) * 0.20 + noun_presence(low) * 0.15 + verb_absence(low) * 0.10
        )

    return _guard(text, 10, lambda t: let(F.lower(t), lambda low: let(words(low), lambda ws: let(lines(t), lambda ls: one(low, ws, ls)))))


def legacy_ingredient_confidence(text: Column) -> Column:
    """SCO42, case-sensitive on purpose: the one-letter units hit nearly every line."""

    def one(ls: Column) -> Column:
        n = F.size(ls)
        return F.least(
            share(count_if(ls, lambda x: any_of(x, v.LEGACY_UNITS)), n) * 0.4
            + share(count_if(ls, lambda x: any_of(x, v.LEGACY_KEYWORDS)), n) * 0.3
            + share(count_if(ls, lambda x: x.rlike(r"(?U)\d")), n) * 0.3,
            F.lit(1.0),
        )

    return _guard(text, 10, lambda t: let(lines(t), one))


