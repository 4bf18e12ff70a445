"""The registered queries of the ten operators, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from potluck.sources.tables import spread

from . import bpe, gif, langid, licenses, minhash, mixing, quality, secrets, sharding, substring
from .common import table

def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample_to_targets(table(spark, sf_dir, "documents")).withColumn("p", F.round("p", 6))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_groups(spread(table(spark, sf_dir, "documents")))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(spread(table(spark, sf_dir, "documents")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(spread(table(spark, sf_dir, "documents")))


def op5_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.histogram_sort(table(spark, sf_dir, "documents"))


def op6_quality_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return quality.score_quality(spread(table(spark, sf_dir, "documents")), trusted)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(spread(table(spark, sf_dir, "documents")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(spread(table(spark, sf_dir, "documents")))


def op9_gif_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has pictures, so every page is drawn as an animated GIF from all of its bytes first."""
    return gif.decode_frames(gif.render_text(spread(table(spark, sf_dir, "pages")), "page_id", "html"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(spread(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_mix_sources,
            op2_near_dedup,
            op3_secret_scan,
            op4_license_scan,
            op5_histogram_sort,
            op6_quality_rule,
            op7_byte_bpe,
            op8_language_id,
            op9_gif_frames,
            op10_substring_dedup,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.oracle()}
