"""Language identification as mixture inference.

Each language is a multinomial over hashed byte trigrams of words, counted over the whole
corpus by language tag. A document is a mixture: every word comes from one of the languages or
from a flat background. Expectation-maximisation finds the proportions; languages leave the
set one by one while the Bayesian information criterion does not get worse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, lean, utf8

BUCKETS, ALPHA, STEPS, FLOOR, ACCEPT = 1 << 15, 0.05, 25, 0.01, 0.3
BACKGROUND = "und"
#: More tags than this are an error: a tag costs 256 kB of models on the driver and in each worker.
MOST_LANGUAGES = 1000


class Trigrams:
    """The words of some texts with the bucket of the trigram around each byte of a word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS):
        w = Words(data, offsets)
        length = w.ends - w.starts
        self.begin = np.cumsum(length) - length
        self.first = w.first
        self.length = length
        at = np.arange(int(length.sum())) - np.repeat(self.begin, length) + np.repeat(w.starts, length)
        x = w.data
        middle = x[at].astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
        left, right = np.zeros_like(middle), np.zeros_like(middle)
        if len(middle):
            left[1:], right[:-1] = middle[:-1], middle[1:]
            left[self.begin] = 0
            right[self.begin + length - 1] = 0
        h = ((left << np.uint32(16)) | (middle << np.uint32(8)) | right) * np.uint32(0x9E3779B1)
        self.bucket = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64)


def _counter(languages: list[str], buckets: int):
    index = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), buckets), np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            tag = np.array([index[t] for t in batch.column(1).to_pylist()], dtype=np.int64)
            for lo, hi in chunks(offsets):
                part = offsets[lo : hi + 1]
                t = Trigrams(data[part[0] : part[-1]], part - part[0], buckets)
                per_doc = np.add.reduceat(np.append(t.length, 0), t.first[:-1]) * (np.diff(t.first) > 0) if len(t.length) else np.zeros(hi - lo, np.int64)
                code = np.repeat(tag[lo:hi], per_doc) * buckets + t.bucket
                total += np.bincount(code, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bucket), pa.array(total[lang, bucket])], names=["lang", "bucket", "n"])

    return count


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS, alpha: float = ALPHA) -> tuple[list[str], np.ndarray]:
    """Language names and log probabilities (languages + background, buckets), over all tagged documents."""
    tagged = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    names = sorted(r[0] for r in tagged.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} language tags: the models would not fit the driver; clean the tags first")
    n = np.full((len(names), buckets), alpha)
    if names:
        rows = tagged.mapInArrow(lean(_counter(names, buckets)), "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
        n[rows["lang"], rows["bucket"]] += rows["n"]
    model = np.log(n / n.sum(axis=1, keepdims=True)) if names else np.zeros((0, buckets))
    return names, np.vstack([model, np.full((1, buckets), -np.log(buckets))])


def word_likelihoods(t: Trigrams, model: np.ndarray) -> np.ndarray:
    """(languages, words) log-likelihoods."""
    if not len(t.length):
        return np.zeros((len(model), 0))
    return np.stack([np.add.reduceat(row[t.bucket], t.begin) for row in model])


def fit(logp: np.ndarray, first: np.ndarray, active: np.ndarray, steps: int = STEPS, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """EM of every document's proportions over its active languages. Returns (documents, languages) and log-likelihoods.

    A document takes at most `steps` steps and ends with the first that moves it by less than 1e-4. Documents without words are not allowed here. first are the bounds of the documents' words.
    """
    docs = len(first) - 1
    doc = np.repeat(np.arange(docs), np.diff(first))
    begin = first[:-1]
    top = np.where(active[doc].T, logp, -np.inf).max(axis=0)
    p = np.exp(np.maximum(logp - top, -60.0)) * active[doc].T
    pi = active / active.sum(axis=1, keepdims=True) if start is None else start * active / np.maximum((start * active).sum(axis=1, keepdims=True), 1e-300)
    # a document stays as it is once its own step is small, so its result does not depend on what shares its batch
    live, some, bounds, owner = np.arange(docs), p, first, doc
    open_ = np.ones(docs, dtype=bool)
    for _ in range(steps):
        now = pi[live]
        joint = some * now[owner].T
        joint /= np.maximum(joint.sum(axis=0), 1e-300)
        new = np.stack([np.add.reduceat(row, bounds[:-1]) for row in joint], axis=1) / np.diff(bounds)[:, None]
        pi[live[open_]] = new[open_]
        open_ &= np.abs(new - now).max(axis=1) >= 1e-4
        if not open_.any():
            break
        if open_.mean() < 0.8:
            words, bounds = _part(bounds, np.flatnonzero(open_))
            live, some = live[open_], some[:, words]
            owner = np.repeat(np.arange(len(live)), np.diff(bounds))
            open_ = np.ones(len(live), dtype=bool)
    each = np.log(np.maximum((p * pi[doc].T).sum(axis=0), 1e-300)) + top
    return pi, np.add.reduceat(each, begin)


def _part(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and bounds of a choice of documents."""
    n = np.diff(first)[which]
    bounds = np.concatenate([[0], np.cumsum(n)])
    return np.arange(bounds[-1]) - np.repeat(bounds[:-1], n) + np.repeat(first[:-1][which], n), bounds


def infer(logp: np.ndarray, first: np.ndarray, steps: int = STEPS, floor: float = FLOOR) -> np.ndarray:
    """Proportions (documents, languages) after selecting each document's set by penalised likelihood."""
    k, docs = len(logp), len(first) - 1
    out = np.zeros((docs, k))
    some = np.flatnonzero(np.diff(first) > 0)
    if not len(some):
        return out
    words, bounds = _part(first, some)
    mine = logp[:, words]
    active = np.ones((len(some), k), dtype=bool)
    pi, ll = fit(mine, bounds, active, steps)
    # shares too small to pay for a parameter leave at once, without a fit of their own
    weak = (pi < floor) & (pi < pi.max(axis=1, keepdims=True))
    pi[weak] = 0
    pi /= pi.sum(axis=1, keepdims=True)
    active = ~weak
    open_ = np.flatnonzero(active.sum(axis=1) > 1)
    fresh = np.zeros(len(some), dtype=bool)
    while len(open_):
        w, b = _part(bounds, open_)
        local = mine[:, w]
        rows = np.arange(len(open_))
        old = open_[~fresh[open_]]
        if len(old):
            w0, b0 = _part(bounds, old)
            pi[old], ll[old] = fit(mine[:, w0], b0, active[old], steps, pi[old])
            fresh[old] = True
        weakest = np.where(active[open_], pi[open_], np.inf).argmin(axis=1)
        less = active[open_].copy()
        less[rows, weakest] = False
        pi2, ll2 = fit(local, b, less, steps, pi[open_] + 1e-3)
        better = 2 * (ll[open_] - ll2) <= np.log(np.diff(b))  # one parameter less costs less than it saves
        took = open_[better]
        pi[took], ll[took], active[took] = pi2[better], ll2[better], less[better]
        open_ = took[active[took].sum(axis=1) > 1]
    out[some] = pi
    return out


SCHEMA = "doc_id long, n_words long, languages array<string>, shares array<double>, lang_id string, accepted boolean"


def _identifier(names: list[str], model, steps: int, floor: float, accept: float):
    every = [*names, BACKGROUND]

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in chunks(offsets):
                part = offsets[lo : hi + 1]
                t = Trigrams(data[part[0] : part[-1]], part - part[0], table.shape[1])
                pi = np.round(infer(word_likelihoods(t, table), t.first, steps, floor), 4)
                order = np.argsort(-pi, axis=1, kind="stable")
                sets = [[int(j) for j in row if p[j] > 0] for row, p in zip(order, pi)]
                known = pi[:, : len(names)].sum(axis=1)
                best = [next((j for j in s if j < len(names)), len(names)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(t.first).astype(np.int64)),
                        pa.array([[every[j] for j in s] for s in sets], pa.list_(pa.string())),
                        pa.array([[float(p[j]) for j in s] for s, p in zip(sets, pi)], pa.list_(pa.float64())),
                        pa.array([every[b] for b in best], pa.string()),
                        pa.array(known >= accept),
                    ],
                    names=["doc_id", "n_words", "languages", "shares", "lang_id", "accepted"],
                )

    return identify


def identify_languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    steps: int = STEPS,
    floor: float = FLOOR,
    accept: float = ACCEPT,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(doc_id, n_words, languages, shares, lang_id, accepted) of every document.

    languages is the selected set by falling share ("und" is the background), lang_id the first
    known one; a document is accepted if the known languages' shares reach `accept` together. The
    models are counted over all documents with a tag; what is collected and broadcast is
    languages x buckets, whatever the corpus; more than MOST_LANGUAGES tags raise ValueError.

    A null or empty text, or one without words, has an empty set, lang_id "und" and is not
    accepted; a null tag takes no part in training; a null id stays null; repeated rows are
    answered each; ties go to the first name; with no tagged rows everything is "und"; other columns are not read.
    """
    names, model = train(docs, text_col, lang_col, buckets)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(lean(_identifier(names, shared, steps, floor, accept)), SCHEMA)


def _filterer(names: list[str], model, steps: int, floor: float, accept: float):
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            keep = np.zeros(batch.num_rows, dtype=bool)
            for lo, hi in chunks(offsets):
                part = offsets[lo : hi + 1]
                t = Trigrams(data[part[0] : part[-1]], part - part[0], table.shape[1])
                pi = np.round(infer(word_likelihoods(t, table), t.first, steps, floor), 4)
                keep[lo:hi] = pi[:, : len(names)].sum(axis=1) >= accept
            yield batch.filter(pa.array(keep))

    return choose


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", steps: int = STEPS, floor: float = FLOOR, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs whose document identify_languages would accept, with all columns, in one pass after training."""
    names, model = train(docs, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ordered = docs.select(text_col, *[c for c in docs.columns if c != text_col])
    return ordered.mapInArrow(lean(_filterer(names, shared, steps, floor, accept)), ordered.schema).select(*docs.columns)
