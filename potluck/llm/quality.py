"""Quality rule: hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Both multinomials are over hashed byte n-grams. A document's score is the mean over its
n-grams of log p_target - log p_raw, so length cancels; one fixed threshold decides on each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, utf8

BUCKETS, ORDER, ALPHA, THRESHOLD = 1 << 16, 4, 1.0, -0.2
#: Most trusted documents whose n-grams make the target multinomial; of more, those with the least hash of the id are taken.
TRUSTED = 20_000


def gram_buckets(data: np.ndarray, offsets: np.ndarray, order: int = ORDER, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte n-gram inside a document, and the document of each; a shorter text has none."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = np.zeros(n, dtype=np.uint64)
    for j in range(order):
        x = x * np.uint64(257) + data[j : j + n].astype(np.uint64) + np.uint64(1)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = ((x >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    count = np.maximum(0, np.diff(offsets) - order + 1)
    doc = np.repeat(np.arange(len(count)), count)
    inside = np.repeat(offsets[:-1], count) + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return bucket[inside], doc


def _counter(order: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            trusted = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in chunks(offsets):
                part = offsets[lo : hi + 1]
                bucket, doc = gram_buckets(data[part[0] : part[-1]], part - part[0], order, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                t = trusted[lo:hi][doc]
                if t.any():
                    target += np.bincount(bucket[t], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    return count


def log_ratios(docs: DataFrame, trusted: DataFrame, order: int = ORDER, buckets: int = BUCKETS, alpha: float = ALPHA, most: int = TRUSTED) -> np.ndarray:
    """log p_target - log p_raw of every bucket; raw counts are over all of docs(doc_id, text), target ones over trusted(doc_id).

    p_raw is smoothed by alpha for each bucket, p_target by as many grams in all spread as in p_raw,
    so that without evidence the ratio is 0, however small the target is.
    """
    ids = trusted.where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    marked = docs.join(F.broadcast(ids.withColumn("__t", F.lit(True))), "doc_id", "left").select("text", F.coalesce("__t", F.lit(False)).alias("t"))
    rows = (
        marked.mapInArrow(_counter(order, buckets), "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .toPandas()
    )
    raw, target = np.full(buckets, alpha), np.zeros(buckets)
    raw[rows["bucket"]] += rows["raw"]
    target[rows["bucket"]] += rows["target"]
    p_raw = raw / raw.sum()
    prior = alpha * buckets
    return np.log((target + prior * p_raw) / (target.sum() + prior)) - np.log(p_raw)


def _scorer(weights, order: int, threshold: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            n = np.zeros(batch.num_rows, np.int64)
            total = np.zeros(batch.num_rows)
            for lo, hi in chunks(offsets):
                part = offsets[lo : hi + 1]
                bucket, doc = gram_buckets(data[part[0] : part[-1]], part - part[0], order, len(w))
                n[lo:hi] = np.bincount(doc, minlength=hi - lo)
                total[lo:hi] = np.bincount(doc, weights=w[bucket], minlength=hi - lo)
            mean = np.round(np.divide(total, n, out=np.zeros_like(total), where=n > 0), 6)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(mean), pa.array((n > 0) & (mean >= threshold))], names=["doc_id", "n_grams", "score", "keep"]
            )

    return score


def score_quality(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    buckets: int = BUCKETS,
    alpha: float = ALPHA,
    threshold: float = THRESHOLD,
    most_trusted: int = TRUSTED,
) -> DataFrame:
    """(doc_id, n_grams, score, keep) of every document; keep = score >= threshold.

    `trusted` has the ids (doc_id) of trusted documents; at most `most_trusted` of them, by hash of
    the id, make the target multinomial. The raw one is counted over all documents. Both are
    smoothed and have `buckets` cells, so what is collected and broadcast has a fixed size.

    A null or empty text, or one shorter than `order` bytes, has n_grams 0, score 0 and is not
    kept; a null id stays null and is never trusted; repeated rows count each time and score
    alike; without trusted documents every score is 0; other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    w = log_ratios(base, trusted.select(F.col("doc_id").cast("long").alias("doc_id")), order, buckets, alpha, most_trusted)
    shared = docs.sparkSession.sparkContext.broadcast(w)
    return base.mapInArrow(_scorer(shared, order, threshold), "doc_id long, n_grams long, score double, keep boolean")
