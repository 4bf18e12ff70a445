import base64
import os
import re

import numpy as np
import pytest

import corpus_pipeline
from potluck.llm import bpe, langid, minhash, mixing, secrets
from potluck.llm import queries as q

from .test_minhash import brute as all_pairs
from .test_secrets_licenses import brute as secrets_of
from .util import SCHEMA, clashing, prose

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA) or not os.path.exists(bpe.VOCABULARY), reason="no test data here")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secret_scan", "mix_sources", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns, name


def test_run_equals_the_stages_rows_by_rows(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    frame = lambda: spark.createDataFrame(list(docs.values()), "doc_id long, text string, lang string, source string, n_chars long")
    bad = {r["doc_id"] for r in langid.identify_languages(frame()).collect() if not r["accepted"]}
    docs = {i: r for i, r in docs.items() if i not in bad}
    gone = {r["doc_id"] for r in minhash.near_duplicate_groups(frame()).collect() if not r["keep"]}
    docs = {i: r for i, r in docs.items() if i not in gone}
    texts = {i: r["text"] for i, r in docs.items()}
    for r in sorted(secrets.find_secrets(frame()).collect(), key=lambda r: -r["start"]):
        t = texts[r["doc_id"]]
        texts[r["doc_id"]] = t[: r["start"]] + "[SECRET]" + t[r["end"] :]
    docs = {i: (i, texts[i], r["lang"], r["source"], len(texts[i])) for i, r in docs.items()}
    kept = {r["doc_id"] for r in mixing.sample_to_targets(frame(), fraction=corpus_pipeline.MIX_FRACTION).collect()}
    ids, bounds = bpe.Encoder().encode([texts[i] for i in sorted(kept)])
    want = {i: ids[lo:hi].tolist() for i, lo, hi in zip(sorted(kept), bounds[:-1], bounds[1:])}
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"]: r["tokens"] for r in got} == want and all(r["exact"] for r in got)


def brute_fit(logp, active):
    """EM of one document over its active languages."""
    pi = np.where(active, 1 / active.sum(), 0.0) if active.dtype == bool else active / active.sum()
    on = pi > 0
    top = logp[on].max(axis=0)
    p = np.where(on[:, None], np.exp(np.maximum(logp - top, -60)), 0)
    for _ in range(langid.STEPS):
        joint = p * pi[:, None]
        new = (joint / joint.sum(axis=0)).mean(axis=1)
        small = np.abs(new - pi).max() < 1e-4
        pi = new
        if small:
            break
    return pi, (np.log((p * pi[:, None]).sum(axis=0)) + top).sum()


def brute_languages(rows):
    """Ids of the documents whose known languages have a share of 0.3 together: counts with dictionaries, one document after another."""

    def words(text):
        low = "".join(c.lower() if c.isascii() or (0xC0 <= ord(c) <= 0xDE and ord(c) != 0xD7) else c for c in text).encode()
        return re.findall(rb"[0-9a-z_\x80-\xff]+", low)

    def bucket(a, b, c):
        h = ((a << 16 | b << 8 | c) * 0x9E3779B1) & 0xFFFFFFFF
        return (((h ^ h >> 15) * 0x85EBCA77) & 0xFFFFFFFF) >> 17

    grams = {r["doc_id"]: [[bucket(*x) for x in zip(b"\0" + w[:-1], w, w[1:] + b"\0")] for w in words(r["text"] or "")] for r in rows}
    names = sorted({r["lang"] for r in rows if r["lang"]})
    models = []
    for name in names:
        n = np.full(langid.BUCKETS, langid.ALPHA)
        for r in rows:
            if r["lang"] == name:
                for w in grams[r["doc_id"]]:
                    for x in w:
                        n[x] += 1
        models.append(np.log(n / n.sum()))
    models.append(np.full(langid.BUCKETS, -np.log(langid.BUCKETS)))
    good = set()
    for i, some in grams.items():
        if not some:
            continue
        logp = np.array([[m[w].sum() for w in some] for m in models])
        pi, ll = brute_fit(logp, np.ones(len(models), bool))
        pi = np.where((pi < langid.FLOOR) & (pi < pi.max()), 0, pi)
        pi, fitted = pi / pi.sum(), False
        while (pi > 0).sum() > 1:
            if not fitted:
                pi, ll = brute_fit(logp, pi)
                fitted = True
            less = np.where(pi > 0, pi + 1e-3, 0)
            less[np.where(pi > 0, pi, np.inf).argmin()] = 0
            after, score = brute_fit(logp, less)
            if 2 * (ll - score) > np.log(len(some)):
                break
            pi, ll = after, score
        if np.round(pi, 4)[:-1].sum() >= langid.ACCEPT:
            good.add(i)
    return good


def test_run_equals_brute_force(spark):
    """Every stage anew without its operator: plain EM, all pairs, counted windows, SQL and another encoder."""
    duckdb, tiktoken, pd = pytest.importorskip("duckdb"), pytest.importorskip("tiktoken"), pytest.importorskip("pandas")
    ranks = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(ranks):
        pytest.skip("no rank file here")
    rows = [r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    good = brute_languages(rows)
    rows = [r for r in rows if r["doc_id"] in good]
    groups = all_pairs({r["doc_id"]: r["text"] for r in rows}, minhash.THRESHOLD)
    rows = [r for r in rows if groups.get(r["doc_id"], r["doc_id"]) == r["doc_id"]]
    for r in rows:
        for a, b, _ in sorted(secrets_of(r["text"]), reverse=True):
            r["text"] = r["text"][:a] + "[SECRET]" + r["text"][b:]
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(rows))
    kept = {x[0] for x in c.sql(mixing.oracle(corpus_pipeline.MIX_FRACTION)).fetchall()}
    with open(ranks, "rb") as f:
        usual = tiktoken.Encoding("z", pat_str=bpe.PATTERN, mergeable_ranks={base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}, special_tokens={})
    want = {r["doc_id"]: usual.encode_ordinary(r["text"]) for r in rows if r["doc_id"] in kept}
    got = {r["doc_id"]: r["tokens"] for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want and 50 < len(want) < 200


HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def awkward(spark):
    text = "the house and the river with water and people in the morning "
    long = (text * 9000) + prose(1, 500)
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, None, "en", "a", None), (3, text, None, None, 61), (4, text * 2 + HEX, "en", "a", 1), (5, long, "en", "b", 1), (6, text, "en", "a", 61), (6, text, "en", "a", 61), (7, "!!!", "en", "a", 3)]
    return clashing(spark.createDataFrame(rows, SCHEMA), "keep", "group_id", "gone", "cell", "p", "tokens", "n_tokens", "exact", "topic", "sig")


EXPECTED = {
    "language_id": [3, 4, 5, 6, 6],
    "near_dedup": [None, 1, 2, 3, 5, 7],  # 4 and 6 are near copies of 3
    "secret_scan": [None, 1, 2, 3, 4, 5, 6, 6, 7],
    "byte_bpe": [None, 1, 2, 3, 4, 5, 6, 6, 7],
}


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_awkward_rows(spark, name, stage):
    df = awkward(spark)
    out = stage(spark, df, DATA)
    ids = sorted((r["doc_id"] for r in out.select("doc_id").collect()), key=lambda i: -1 if i is None else i)
    assert ids == EXPECTED[name] if name in EXPECTED else set(ids) <= {r["doc_id"] for r in df.collect()}
    assert out.columns == (corpus_pipeline.COLUMNS if name != "byte_bpe" else ["doc_id", "n_tokens", "tokens", "exact"])
    if name == "secret_scan":
        got = {r["doc_id"]: r for r in out.collect()}
        assert HEX not in got[4]["text"] and got[4]["n_chars"] == len(got[4]["text"]) and got[2]["text"] is None and got[2]["n_chars"] is None
    assert stage(spark, df.limit(0), DATA).count() == 0


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_queries_run(spark, name):
    df = q.queries()[name](spark, DATA)
    assert df.columns and (df.count() > 0 or name == "op3_secret_scan")  # this table has no secret
