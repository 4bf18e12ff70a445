import itertools
import math
from collections import Counter

import numpy as np
import pytest

from potluck.llm import langid as g
from potluck.llm import quality as q

from .util import SCHEMA, clashing, prose, table

WORDS = {
    "en": "the and with have from that this river house water morning people always through weather".split(),
    "de": "der und mit haben von dass diese fluss haus wasser morgen leute immer durch wetter strasse".split(),
    "fr": "le et avec avoir de que cette rivière maison eau matin gens toujours travers météo école".split(),
}


def speak(lang, seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS[lang], n))


def brute_scores(texts, trusted, order=q.ORDER, buckets=q.BUCKETS, alpha=q.ALPHA):
    """Counts and mean log ratios with plain loops over bytes; only the bucket function is shared."""

    def grams(t):
        b = (t or "").encode()
        return [int(q.gram_buckets(np.frombuffer(b[i : i + order], np.uint8), np.array([0, order]), order, buckets)[0][0]) for i in range(len(b) - order + 1)]

    raw, target = Counter(), Counter()
    for i, t in texts:
        raw.update(grams(t))
        if i in trusted:
            target.update(grams(t))
    n, prior = sum(raw.values()) + alpha * buckets, alpha * buckets
    p = lambda k: (raw[k] + alpha) / n
    ratio = lambda k: math.log((target[k] + prior * p(k)) / (sum(target.values()) + prior) / p(k))
    return [(i, len(x), sum(map(ratio, x)) / len(x) if x else 0.0) for i, t in texts for x in [grams(t)]]


def test_scores_equal_brute_force(spark):
    texts = [(i, speak("en", i, 20)) for i in range(8)] + [(i, "### " * 12) for i in range(8, 12)] + [(12, "é"), (13, None), (14, "abc")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], SCHEMA)
    trusted = spark.createDataFrame([(0,), (1,), (2,), (99,), (None,)], "doc_id long")
    got = {r["doc_id"]: r for r in q.score_quality(df, trusted).collect()}
    for i, n, score in brute_scores(texts, {0, 1, 2}):
        assert got[i]["n_grams"] == n and abs(got[i]["score"] - score) < 1e-5
        assert got[i]["keep"] == (n > 0 and round(score, 6) >= q.THRESHOLD)
    assert min(got[i]["score"] for i in range(8)) > 0 > max(got[i]["score"] for i in range(8, 12)) and not any(got[i]["keep"] for i in (12, 13, 14))


def test_held_out_documents_are_told_apart(spark):
    good = [(i, speak("en", i, 60)) for i in range(60)]
    bad = [(100 + i, " ".join(f"{w.upper()}!!" for w in speak("en", 500 + i, 60).split())) for i in range(20)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in good + bad], SCHEMA)
    trusted = spark.createDataFrame([(i,) for i in range(30)], "doc_id long")
    keep = {r["doc_id"]: r["keep"] for r in q.score_quality(df, trusted, alpha=0.001).collect()}  # a prior of 65 grams suits so small a table
    assert all(keep[i] for i in range(60)) and not any(keep[100 + i] for i in range(20))


def test_quality_awkward_rows(spark):
    long = speak("en", 1, 60_000)
    df = clashing(table(spark, [None, "", "abc", long, "same text here", "same text here"], ids=[None, 1, 2, 3, 4, 4]), "keep", "score", "t", "__t", "n_grams", "raw", "bucket")
    none = spark.createDataFrame([], "doc_id long")
    rows = q.score_quality(df, none).collect()
    assert len(rows) == 6 and sorted(r["n_grams"] for r in rows)[:3] == [0, 0, 0] and len({r["score"] for r in rows if r["doc_id"] == 4}) == 1
    assert q.score_quality(df.limit(0), none).count() == 0


def test_trusted_bound_is_kept(spark):
    df = table(spark, [prose(i, 20) for i in range(10)])
    trusted = spark.range(10).withColumnRenamed("id", "doc_id")
    few = q.log_ratios(df.select("doc_id", "text"), trusted, most=3)
    assert not np.allclose(few, q.log_ratios(df.select("doc_id", "text"), trusted, most=10))


def corpus(spark):
    rows = [(i, speak(lang, i, 40), lang, "s", 0) for i, lang in enumerate(itertools.islice(itertools.cycle(WORDS), 90))]
    mixed = [(1000 + i, speak("en", 2000 + i, 30) + " " + speak("de", 3000 + i, 30), None, "s", 0) for i in range(10)]
    held = [(2000 + i, speak(lang, 5000 + i, 25), None, "s", 0) for i, lang in enumerate(itertools.islice(itertools.cycle(WORDS), 30))]
    junk = [(3000 + i, " ".join(f"zx{j}qj{i}vk" for j in range(30)), None, "s", 0) for i in range(5)]
    return spark.createDataFrame(rows + mixed + held + junk, SCHEMA)


def test_held_out_accuracy_and_mixtures(spark):
    got = {r["doc_id"]: r for r in g.identify_languages(corpus(spark)).collect()}
    names = list(itertools.islice(itertools.cycle(WORDS), 30))
    assert all(got[2000 + i]["languages"] == [n] and got[2000 + i]["accepted"] for i, n in enumerate(names))
    assert all(sorted(got[1000 + i]["languages"]) == ["de", "en"] and abs(got[1000 + i]["shares"][0] - 0.5) < 0.15 for i in range(10))
    assert not any(got[3000 + i]["accepted"] for i in range(5))
    kept = {r["doc_id"] for r in g.keep_identified(corpus(spark)).collect()}
    assert kept == {i for i, r in got.items() if r["accepted"]}


def brute_em(logp, steps):
    """EM of one document with plain loops."""
    k, n = len(logp), len(logp[0])
    pi = [1 / k] * k
    for _ in range(steps):
        new = [0.0] * k
        for w in range(n):
            z = sum(pi[j] * math.exp(logp[j][w]) for j in range(k))
            for j in range(k):
                new[j] += pi[j] * math.exp(logp[j][w]) / z / n
        pi = new
    return pi, sum(math.log(sum(pi[j] * math.exp(logp[j][w]) for j in range(k))) for w in range(n))


def test_em_equals_brute_force():
    rng = np.random.default_rng(0)
    logp = -rng.random((3, 17)) * 6
    first = np.array([0, 5, 17])
    pi, ll = g.fit(logp, first, np.ones((2, 3), bool), steps=7)
    for d in range(2):
        want, score = brute_em(logp[:, first[d] : first[d + 1]].tolist(), 7)
        assert np.allclose(pi[d], want, atol=1e-3) and abs(ll[d] - score) < 0.01


def test_selection_drops_what_does_not_pay():
    # the second language explains the words only a little worse: one is enough
    logp = np.stack([np.full(30, -2.0), np.full(30, -2.1)])
    assert g.infer(logp, np.array([0, 30])).tolist() == [[1.0, 0.0]]
    two = np.concatenate([np.stack([np.full(30, -2.0), np.full(30, -9.0)]), np.stack([np.full(30, -9.0), np.full(30, -2.0)])], axis=1)
    assert np.allclose(g.infer(two, np.array([0, 60])), [[0.5, 0.5]], atol=0.01)


def test_trigrams_stay_in_words():
    t = g.Trigrams(np.frombuffer("ab  cd".encode(), np.uint8), np.array([0, 3, 6]))
    u = g.Trigrams(np.frombuffer("cd".encode(), np.uint8), np.array([0, 2]))
    assert t.first.tolist() == [0, 1, 2] and t.bucket[2:].tolist() == u.bucket.tolist()


@pytest.mark.parametrize("tagged", [True, False])
def test_langid_awkward_rows(spark, tagged):
    long = speak("en", 1, 40_000)
    rows = [(None, None, None), (1, "", "en"), (2, "!!! ???", "en"), (3, long, "en"), (4, speak("de", 1, 30), "de"), (4, speak("de", 1, 30), "de")]
    df = spark.createDataFrame([(i, t, x if tagged else None, "s", 0) for i, t, x in rows], SCHEMA)
    df = clashing(df, "languages", "accepted", "shares", "bucket", "n", "lang_id")
    got = g.identify_languages(df).collect()
    assert len(got) == 6 and all(not r["accepted"] and r["languages"] == [] and r["lang_id"] == "und" for r in got if r["n_words"] == 0)
    assert sum(r["accepted"] for r in got) == (3 if tagged else 0)
    kept = g.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == (3 if tagged else 0)
    assert g.identify_languages(df.limit(0)).count() == 0 and g.keep_identified(df.limit(0)).count() == 0


def test_a_document_does_not_depend_on_its_batch():
    rng = np.random.default_rng(9)
    first = np.concatenate([[0], np.cumsum(rng.integers(1, 60, 40))])
    logp = rng.normal(-8, 2, (5, first[-1])) + 4 * (np.arange(5)[:, None] == np.repeat(rng.integers(0, 5, 40), np.diff(first)))
    pi, ll = g.fit(logp, first, np.ones((40, 5), bool))
    whole = g.infer(logp, first)
    for i in range(40):
        part = logp[:, first[i] : first[i + 1]]
        alone = np.array([0, part.shape[1]])
        one, l1 = g.fit(part, alone, np.ones((1, 5), bool))
        assert np.allclose(one[0], pi[i], rtol=0, atol=1e-12) and np.isclose(l1[0], ll[i])
        assert np.allclose(g.infer(part, alone)[0], whole[i], rtol=0, atol=1e-12)
