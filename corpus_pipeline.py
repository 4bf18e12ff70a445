"""A training corpus from raw documents: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as
Parquet in the shared folder and the next stage reads it from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from potluck.llm import bpe, langid, minhash, mixing, secrets
from potluck.llm.common import cut, drop_cut, drop_since, mark, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of the tokens that the mixing stage keeps.
MIX_FRACTION = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the known languages have too small a share go.

    A null or empty text, or one without words, has no language and goes; a null tag, source or id is
    no reason to go; repeated rows are judged each; an empty table stays empty; other columns are dropped.
    """
    return langid.keep_identified(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays.

    Rows with a null id, a null or empty text or no words are in no group and stay; rows that
    repeat an id are one document, which stays or goes as a whole; an empty table stays empty.
    """
    return minhash.drop_near_duplicates(docs).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays, with its new length.

    A null text stays null, with a null length; an empty one stays empty; repeated rows are masked alike.
    """
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by probabilities raked to source, language and topic targets.

    Null sources and languages are a value of their own; a null or empty text weighs nothing but is
    sampled with its cell; rows that repeat an id in one cell stay or go together.
    """
    return mixing.sample_documents(docs, fraction=MIX_FRACTION).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, tokens, exact): the documents as token ids; a null or empty text has none, a null id stays null."""
    return bpe.tokenize(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]

#: Mixture inference, signatures, windowed entropies and merges are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        place = mark()
        docs, path = cut(stage(spark, docs, sf_dir))
        # the stage is written: neither its own tables nor its predecessor's are read again
        drop_since(spark, place, path)
        if before is not None:
            drop_cut(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
