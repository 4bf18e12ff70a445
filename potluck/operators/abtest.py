"""Comparison of two extraction results per row, its statistics and report (A/B operator, AGG2, AGG3, SRT4, SNK11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare(old: Column, new: Column, details: Column, threshold: int = 25) -> Column:
    """A struct of both results; a result succeeds if it is longer than the threshold."""
    ok = lambda c: F.coalesce(F.length(c), F.lit(0)) > threshold
    n = lambda c: F.coalesce(F.length(c), F.lit(0))
    return F.struct(
        old.alias("old_ingredients"),
        new.alias("new_ingredients"),
        n(old).alias("old_length"),
        n(new).alias("new_length"),
        ok(old).alias("old_success"),
        ok(new).alias("new_success"),
        (ok(old) == ok(new)).alias("agreement"),
        F.coalesce(details["confidence"], F.lit(0.0)).alias("confidence"),
        F.coalesce(details["linguistic_score"], F.lit(0.0)).alias("linguistic_score"),
        details["strategy"].alias("strategy"),
        F.coalesce(details["used_structural_detector"], F.lit(False)).alias("used_structural_detector"),
    )


def _at(name: str) -> Column:
    return F.get_json_object("metadata", f"$.ab_test.{name}")


def _rate(name: str) -> Column:
    return F.coalesce(F.avg(_at(name).cast("boolean").cast("int")), F.lit(0.0)) * 100


def statistics(recipes: DataFrame) -> DataFrame:
    """One row over the recipes whose metadata has an ab_test; zeros where there are none."""
    return recipes.where(F.get_json_object("metadata", "$.ab_test").isNotNull()).agg(
        F.count(F.lit(1)).alias("total_tests"),
        _rate("agreement").alias("agreement_rate"),
        _rate("old_success").alias("old_success_rate"),
        _rate("new_success").alias("new_success_rate"),
        F.coalesce(F.avg(_at("confidence").cast("double")), F.lit(0.0)).alias("avg_confidence"),
    )


def disagreements(recipes: DataFrame) -> DataFrame:
    """Rows whose results disagree, the most confident first (a null confidence counts as 0)."""
    return (
        recipes.where(_at("agreement") == "false")
        .select(
            "title",
            "book",
            F.coalesce(_at("old_success").cast("boolean"), F.lit(False)).alias("old_success"),
            F.coalesce(_at("new_success").cast("boolean"), F.lit(False)).alias("new_success"),
            _at("confidence").cast("double").alias("confidence"),
            _at("strategy").alias("strategy"),
        )
        .orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "title", "book")
    )


def messages(recipes: DataFrame, level: str = "INFO") -> DataFrame:
    """(title, severity, message) of the comparisons that a log level asks for: disagreements at DEBUG and INFO, agreements at DEBUG, none else."""
    agree, old, new = (_at(c) == "true" for c in ("agreement", "old_success", "new_success"))
    word = lambda c: F.when(c, "True").otherwise("False")
    apart = F.format_string("A/B DISAGREEMENT: old=%s, new=%s, confidence=%.2f", word(old), word(new), F.coalesce(_at("confidence").cast("double"), F.lit(0.0)))
    alike = F.concat(F.lit("A/B AGREEMENT: both "), F.when(old, "succeeded").otherwise("failed"))
    wanted = F.lit(False) if level not in ("DEBUG", "INFO") else F.lit(True) if level == "DEBUG" else ~agree
    return recipes.where(F.get_json_object("metadata", "$.ab_test").isNotNull() & wanted).select(
        "title", F.when(agree, "DEBUG").otherwise("WARNING").alias("severity"), F.when(agree, alike).otherwise(apart).alias("message")
    )


def report(recipes: DataFrame) -> str:
    """A text of fixed width with the statistics and the ten most confident disagreements."""
    s, bar = statistics(recipes).first(), "=" * 70
    cases = disagreements(recipes)
    n = cases.count()
    out = [bar, "A/B TESTING REPORT", bar, "", "OVERALL STATISTICS", "-" * 70]
    out.append(f"{'Total tests:':<20}{s['total_tests']}")
    for label, name in (("Agreement rate:", "agreement_rate"), ("Old success rate:", "old_success_rate"), ("New success rate:", "new_success_rate")):
        out.append(f"{label:<20}{s[name]:.1f}%")
    out += [f"{'Avg confidence:':<20}{s['avg_confidence']:.2f}", ""]
    if n:
        out += [f"DISAGREEMENTS ({n} cases)", "-" * 70]
        word = lambda ok: "SUCCESS" if ok else "FAIL"
        for i, c in enumerate(cases.limit(10).collect(), 1):
            sure = "N/A" if c["confidence"] is None else f"{c['confidence']:.2f}"
            out += [f"{i}. {(c['title'] or '')[:50]}", f"   Book: {c['book']}", f"   Old: {word(c['old_success'])}, New: {word(c['new_success'])}"]
            out += [f"   Confidence: {sure}, Strategy: {c['strategy']}", ""]
    else:
        out += ["NO DISAGREEMENTS FOUND", ""]
    return "\n".join([*out, bar])
