"""Summaries of scored recipes and data-quality checks (AGG7, AGG8, AGG16-18, FIL15, SRT5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tier(score: Column) -> Column:
    return F.when(score >= 70, "excellent").when(score >= 50, "good").when(score >= 30, "fair").otherwise("poor")


def tiers(recipes: DataFrame) -> DataFrame:
    """One row: total, average (one decimal) and number and percentage of each tier; zeros for an empty table."""
    t = tier(F.col("quality_score"))
    n = F.count(F.lit(1))
    parts = []
    for name in ("excellent", "good", "fair", "poor"):
        k = F.count_if(t == name)
        parts += [k.alias(name), F.when(n > 0, F.round(k * 100.0 / n, 1)).otherwise(0.0).alias(f"{name}_pct")]
    return recipes.agg(n.alias("total"), F.coalesce(F.round(F.avg("quality_score"), 1), F.lit(0.0)).alias("average"), *parts)


def top(recipes: DataFrame, n: int = 5, by: str = "id") -> DataFrame:
    return recipes.orderBy(F.col("quality_score").desc(), by).limit(n)


def batch_summary(files: DataFrame, recipes: DataFrame) -> DataFrame:
    """One row over files(path, error) and recipes(quality_score)."""
    a = files.agg(F.count_if(F.col("error").isNull()).alias("files_ok"), F.count_if(F.col("error").isNotNull()).alias("files_failed"))
    b = recipes.agg(
        F.count(F.lit(1)).alias("recipes"),
        F.coalesce(F.round(F.avg("quality_score"), 1), F.lit(0.0)).alias("average"),
        F.count_if(F.col("quality_score") >= 70).alias("excellent"),
    )
    return a.crossJoin(b)


def missing(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def garbage(c: str) -> Column:
    """Has a value, but no digit in it."""
    return ~missing(c) & ~F.col(c).rlike("[0-9]")


def leading_number(c: str) -> Column:
    """The integer a value starts with, 0 without one."""
    return F.coalesce(F.regexp_extract(F.col(c), r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, total, missing, garbage, positive) of each column, in one scan."""
    stats = []
    for c in columns:
        stats.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(F.lit(1)).alias("total"),
                F.count_if(missing(c)).alias("missing"),
                F.count_if(garbage(c)).alias("garbage"),
                F.count_if(leading_number(c) > 0).alias("positive"),
            )
        )
    return df.agg(F.array(*stats).alias("a")).select(F.inline("a"))


def top_garbage(df: DataFrame, c: str, n: int = 10) -> DataFrame:
    return df.where(garbage(c)).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "value").limit(n)


def tag_coverage(recipes: DataFrame, links: DataFrame) -> DataFrame:
    tagged = links.agg(F.count_distinct("recipe_id").alias("tagged"))
    return recipes.agg(F.count(F.lit(1)).alias("total")).crossJoin(tagged).withColumn("coverage_pct", F.when(F.col("total") > 0, F.round(F.col("tagged") * 100.0 / F.col("total"), 1)).otherwise(0.0))


def benchmark_means(runs: DataFrame) -> DataFrame:
    """runs(arm, seconds, success, confidence) to means per arm."""
    return runs.groupBy("arm").agg(
        F.avg("seconds").alias("avg_seconds"), (F.avg(F.col("success").cast("int")) * 100).alias("success_rate"), F.avg("confidence").alias("avg_confidence")
    )
