"""Recipe metadata from text: servings, times, method, protein, difficulty (MET1 to MET5, MET13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scoring as s
from . import vocab as v
from .text import any_of, first_group, let, strip, truthy

FIELDS = "serves prep_time cook_time cooking_method protein_type".split()
_DETECTED = ["servings", *FIELDS[1:], "difficulty"]
_RANGE = r"\s*(?:-|to)\s*"


def parse_servings(raw: Column) -> Column:
    """"4", "4-6" or null; "4 to 6" is "4-6"; what stands in round brackets is left out."""
    clean = strip(F.regexp_replace(raw, r"\(.*?\)", ""))

    def one(c: Column) -> Column:
        # the leftmost match of either form counts: a single number before a range wins
        first = F.regexp_extract(c, rf"(?U)\d+{_RANGE}\d+|\d+", 0)
        lo, hi = F.regexp_extract(first, r"(?U)^(\d+)", 1), F.regexp_extract(first, rf"(?U)^\d+{_RANGE}(\d+)", 1)
        return F.when(lo == "", F.lit(None).cast("string")).when(hi != "", F.concat(lo, F.lit("-"), hi)).otherwise(lo)

    return F.when(truthy(raw), let(clean, one))


def parse_time(raw: Column) -> Column:
    """Minutes from 1 to 1440, or null: hours (decimal, cut to whole minutes) plus minutes, else a bare number of minutes."""

    def one(t: Column) -> Column:
        hours = F.regexp_extract(t, r"(?U)(\d+" + v.opt(r"\.\d+") + r")\s*h(?:ou)?rs?", 1)
        minutes = F.regexp_extract(t, r"(?U)(\d+)\s*min(?:ute)?s?", 1)
        sum_ = F.coalesce(F.floor(F.nullif(hours, F.lit("")).try_cast("double") * 60).cast("long"), F.lit(0)) + F.coalesce(
            F.nullif(minutes, F.lit("")).try_cast("long"), F.lit(0)
        )
        bare = F.when(t.rlike(r"(?U)^\d+$"), t.try_cast("long"))
        value = F.when(sum_.between(1, 1440), sum_).when(bare.between(1, 1440), bare)
        return F.when(~t.rlike(r"(?U)(?:\s|^)-\s*\d"), value).cast("int")

    return F.when(truthy(raw), let(strip(F.lower(raw)), one))


def _first(low: Column, choices: list[tuple[str, list[str]]]) -> Column:
    return F.coalesce(*[F.when(any_of(low, ws), F.lit(name)) for name, ws in choices])


def cooking_method(low: Column) -> Column:
    return _first(low, v.METHODS)


def protein_type(low: Column) -> Column:
    return _first(low, [(p, [p]) for p in v.PROTEINS])


def _combined(title: Column, text: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))


def extract_metadata(text: Column, title: Column) -> Column:
    """MET1: a struct of the five fields; times are minutes as strings."""

    def one(x: Column) -> Column:
        return F.struct(
            parse_servings(first_group(x["low"], v.SERVES)).alias("serves"),
            parse_time(strip(first_group(x["low"], v.PREP_TIME))).cast("string").alias("prep_time"),
            parse_time(strip(first_group(x["low"], v.COOK_TIME))).cast("string").alias("cook_time"),
            cooking_method(x["all"]).alias("cooking_method"),
            protein_type(x["all"]).alias("protein_type"),
        )

    return let(F.struct(F.lower(F.coalesce(text, F.lit(""))).alias("low"), _combined(title, text).alias("all")), one)


def validate_metadata(fields: Column) -> Column:
    """MET4 over a map: blank values go, servings and times are parsed again, others pass."""
    parsed = F.transform_values(
        fields,
        lambda k, x: F.when(strip(F.coalesce(x, F.lit(""))) == "", F.lit(None).cast("string"))
        .when(k == "serves", parse_servings(x))
        .when(k.isin("prep_time", "cook_time"), parse_time(x).cast("string"))
        .otherwise(x),
    )
    return F.map_filter(parsed, lambda k, x: x.isNotNull())


def detected_metadata(text: Column, title: Column) -> Column:
    """MET13: per field a struct (value, confidence, raw_text), null where the confidence is 0.3 or less."""

    def entry(value: Column, confidence: Column, raw: Column) -> Column:
        return F.when(value.isNotNull() & (confidence > 0.3), F.struct(value.alias("value"), confidence.alias("confidence"), raw.alias("raw_text")))

    def by_pattern(low: Column, pattern: str, score) -> Column:
        raw = first_group(low, pattern, 0)
        return let(raw, lambda r: entry(strip(F.regexp_extract(r, "(?iU)" + pattern.replace(r"(?=\n|cook|$)", "").replace(r"(?=\n|prep|$)", "").replace("+?)", "+)"), 1)), score(r), r))

    def one(low: Column) -> Column:
        difficulty = F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.struct(F.lit(level).alias("level"), F.lit(w).alias("word"))) for w, level in v.DIFFICULTY])
        method, protein = cooking_method(low), protein_type(low)
        return F.struct(
            by_pattern(low, v.SERVING_NUMBER, s.servings_confidence).alias("servings"),
            by_pattern(low, v.PREP_TIME, s.time_confidence).alias("prep_time"),
            by_pattern(low, v.COOK_TIME, s.time_confidence).alias("cook_time"),
            entry(method, s.method_confidence(low), F.concat(method, F.lit(" cooking"))).alias("cooking_method"),
            entry(protein, s.protein_confidence(low), protein).alias("protein_type"),
            entry(difficulty["level"], s.difficulty_confidence(low), difficulty["word"]).alias("difficulty"),
        )

    return let(_combined(title, text), one)


def metadata_with_patterns(zone_text: Column, zone_count: Column, text: Column, title: Column) -> Column:
    """MET5: fields from the zones if they give any, else MET1; with strategy, confidences and a linguistic score.

    zone_text is the text of all metadata zones joined by blanks; it is used if zone_count > 0.
    """

    def one(d: Column) -> Column:
        none = F.lit(None).cast("string")
        any_field = F.coalesce(*[d["zones"][n]["value"] for n in _DETECTED]).isNotNull()
        structural = (zone_count > 0) & any_field
        z, legacy = d["zones"], d["legacy"]
        values = {
            "serves": (parse_servings(z["servings"]["value"]), z["servings"]["confidence"]),
            "prep_time": (parse_time(z["prep_time"]["value"]).cast("string"), z["prep_time"]["confidence"]),
            "cook_time": (parse_time(z["cook_time"]["value"]).cast("string"), z["cook_time"]["confidence"]),
            "cooking_method": (z["cooking_method"]["value"], z["cooking_method"]["confidence"]),
            "protein_type": (z["protein_type"]["value"], z["protein_type"]["confidence"]),
            "difficulty": (z["difficulty"]["value"], z["difficulty"]["confidence"]),
        }
        both = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
        estimated = {
            "serves": (legacy["serves"], s.field_confidence(legacy["serves"], "servings")),
            "prep_time": (legacy["prep_time"], s.field_confidence(legacy["prep_time"], "time")),
            "cook_time": (legacy["cook_time"], s.field_confidence(legacy["cook_time"], "time")),
            "cooking_method": (legacy["cooking_method"], s.field_confidence(both, "method")),
            "protein_type": (legacy["protein_type"], s.field_confidence(both, "protein")),
            "difficulty": (none, F.lit(0.5)),
        }
        fields = [F.when(structural, values[n][0]).otherwise(estimated[n][0]).alias(n) for n in values]
        confidences = [
            F.when(F.when(structural, values[n][0]).otherwise(estimated[n][0]).isNotNull(), F.when(structural, values[n][1]).otherwise(estimated[n][1])).alias(n) for n in values
        ]
        return F.struct(
            F.struct(*fields).alias("fields"),
            F.struct(*confidences).alias("confidence_scores"),
            F.when(structural, "structural").otherwise("legacy").alias("strategy"),
            (zone_count > 0).alias("used_structural_detector"),
            zone_count.alias("zone_count"),
            F.when(structural & truthy(zone_text), s.metadata_linguistic(zone_text)).alias("linguistic_score"),
        )

    return let(F.struct(detected_metadata(zone_text, title).alias("zones"), extract_metadata(text, title).alias("legacy")), one)

