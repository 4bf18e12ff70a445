import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from potluck.llm import mixing as x
from potluck.llm import queries as q
from potluck.llm import sharding as h

from .util import SCHEMA, clashing, prose, table


def test_rake_meets_marginals():
    rng = np.random.default_rng(0)
    keys = [rng.integers(0, n, 60).astype(str) for n in (4, 3, 2)]
    mass = rng.integers(1, 100, 60).astype(float)
    goals = [{v: 1 / len(set(k)) for v in set(k)} for k in keys]
    w = x.rake(keys, mass, goals, 200)
    for k, g in zip(keys, goals):
        for v, s in g.items():
            assert abs(w[k == v].sum() / mass.sum() - s) < 1e-6


def test_probabilities_meet_the_budget():
    mass, weight = np.array([100.0, 50, 10, 0]), np.array([20.0, 60, 80, 0])
    for fraction in (0.1, 0.5, 0.9):
        p = x.probabilities(mass, weight, fraction)
        assert abs((p * mass).sum() - fraction * mass.sum()) < 1e-9 and p.max() <= 1 and p[3] == 0
        open_ = (p < 1) & (p > 0)
        ratio = (p * mass / np.maximum(weight, 1e-300))[open_]
        assert np.ptp(ratio) < 1e-9  # the cells below 1 keep their proportions
    assert x.probabilities(mass, weight, 1.5).tolist() == [1, 1, 1, 0]
    assert x.probabilities(np.zeros(0), np.zeros(0), 0.5).tolist() == []


def docs(spark, n=3000):
    rng = np.random.default_rng(1)
    rows = [(i, prose(i, int(rng.integers(1, 40))) + (" a@b.c" if i % 7 == 0 else " | x" if i % 5 == 0 else ""), ["en", "en", "en", "fr"][i % 4], f"s{min(3, int(rng.exponential(1)))}", 0) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_sample_moves_towards_targets(spark):
    df = docs(spark)
    targets = {"lang": {"en": 0.5, "fr": 0.5}}
    got = x.sample_to_targets(df, targets=targets, fraction=0.3)
    share = {r["lang"]: r["n"] for r in got.groupBy("lang").agg(F.sum("n_tokens").alias("n")).collect()}
    total = x.tagged(df).agg(F.sum("n_tokens")).first()[0]
    assert abs(share["fr"] / sum(share.values()) - 0.5) < 0.04 and abs(sum(share.values()) / total - 0.3) < 0.03
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in x.sample_documents(df, targets=targets, fraction=0.3).collect())


@pytest.mark.parametrize(
    "more", [{"iterations": 3}, {"iterations": 8, "fraction": 0.95}, {"iterations": 2, "targets": {"lang": {"en": 1.0}, "topic": {"prose": 1e-9, "contact": 1.0}}, "fraction": 0.2}]
)
def test_driver_and_distributed_fits_agree(spark, more):
    df = docs(spark, 400)
    cells = x.tagged(df).groupBy(*x.DIMENSIONS).agg(F.sum("n_tokens").alias("mass"))
    get = lambda d: {(r["source"], r["lang"], r["topic"]): (r["weight"], r["p"]) for r in d.collect()}
    a, b = get(x.cell_probabilities(cells, **more)), get(x.cell_probabilities(cells, **more, driver_cells=0))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], rtol=1e-6) for k in a)


def test_topics_equal_counting(spark):
    rng = np.random.default_rng(3)
    stems = [w for some, _ in x.TOPICS.values() for w in some]
    bits = [*stems, *(w.title() + "s" for w in stems), "the", "relicense", "x_tax", "(bank)", "@", " | ", "***", "###", "\n", "é", "taxi,tax", "tax.", "(tax)", "Bank!?"]
    texts = [" ".join(rng.choice(bits, int(rng.integers(0, 12)))) for _ in range(400)] + ["", None, "tax tax bank", "doctor bank", "bank doctor"]

    def plain(text):
        words = [w.rstrip(x.ENDINGS) for w in re.split(r"\s+", (text or "").lower())]
        n = {name: sum(w in some for w in words) + sum(m in (text or "") for m in marks) for name, (some, marks) in x.TOPICS.items()}
        best = max(n.values())
        return next(k for k, v in n.items() if v == best) if best else "prose"

    got = {r["doc_id"]: r["t"] for r in table(spark, texts).select("doc_id", x.topic(F.col("text")).alias("t")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)} and len(set(got.values())) >= 7


def test_mixing_awkward_rows(spark):
    rows = [(1, None, None, None, 0), (1, None, None, None, 0), (2, "", "en", "a", 0), (None, "x y", "en", "a", 0), (4, prose(1, 50_000), "en", "a", 0), (5, "x\ty\nz", "en", None, 0)]
    df = clashing(spark.createDataFrame(rows, SCHEMA), "p", "topic", "n_tokens", "mass", "weight", "cell", "_cell", "w")
    got = x.sample_to_targets(df, fraction=1.0).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["source"]) for r in got) == [(-1, 2, "a"), (2, 0, "a"), (4, 50_000, "a"), (5, 3, "(none)")]
    kept = x.sample_documents(df, fraction=1.0)
    assert kept.columns == df.columns and kept.count() == 4
    assert x.sample_to_targets(df.limit(0)).count() == 0 and x.sample_documents(df.limit(0)).count() == 0


def test_mixing_sql_agrees(spark):
    duckdb = pytest.importorskip("duckdb")
    df = docs(spark, 500)
    c = duckdb.connect()
    documents = df.toPandas()  # noqa: F841  read by name
    c.register("documents", documents)
    want = sorted(tuple(r) for r in c.sql(x.oracle()).fetchall())
    assert sorted(tuple(r) for r in x.sample_to_targets(df).withColumn("p", F.round("p", 6)).collect()) == want


def shards_of(df, n, **kw):
    rows = h.histogram_sort(df, n, **kw).select("shard", "doc_id", F.octet_length("text").alias("b")).collect()
    return [(r["shard"], r["doc_id"], r["b"]) for r in rows]


@pytest.mark.parametrize("tolerance", [0.0, 0.01, 0.2])
def test_splitters_meet_tolerance_by_brute_force(spark, tolerance):
    rng = np.random.default_rng(3)
    ids = rng.choice(10**12, 2000, replace=False)
    sizes = (rng.pareto(1.2, 2000) * 20 + 1).astype(int)
    slim = spark.createDataFrame([(int(i), int(s)) for i, s in zip(ids, sizes)], "key long, bytes long")
    cuts, rounds = h.splitters(slim, 8, tolerance)
    order = np.argsort(ids)
    cumulative = np.cumsum(sizes[order])
    at = cumulative[np.searchsorted(ids[order], cuts, side="right") - 1]
    goal = cumulative[-1] * np.arange(1, 8) / 8
    best = np.array([np.abs(np.concatenate([[0], cumulative]) - g).min() for g in goal])
    assert (np.abs(at - goal) <= np.maximum(tolerance * cumulative[-1] / 8, best) + 1e-9).all() and rounds < 20


def test_shards_are_ordered_ranges(spark):
    df = table(spark, [prose(i, 5 + i % 50) for i in range(500)], ids=[(i * 7919) % 100_003 for i in range(500)])
    got = shards_of(df, 6)
    assert len(got) == 500 and [g[0] for g in got] == sorted(g[0] for g in got)
    assert [g[1] for g in got] == sorted(g[1] for g in got)  # a global sort
    load = np.bincount([g[0] for g in got], weights=[g[2] for g in got], minlength=6)
    assert load.max() < 1.1 * load.mean()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_query_splits_within_tolerance_by_brute_force(spark, sf):
    """op5 over its whole table: every row once, in order, each boundary within 1 % of a shard or at the nearest key there is."""
    where = f"/root/testdata/{sf}"
    if not os.path.isdir(where):
        pytest.skip("no test data here")
    docs = spark.read.parquet(f"{where}/documents.parquet")
    got = q.op5_histogram_sort(spark, where).select("shard", "doc_id", F.octet_length("text").alias("b")).collect()
    rows = sorted((r["doc_id"], r["octet_length(text)"] or 0) for r in docs.select("doc_id", F.octet_length("text")).collect())
    assert [(r["doc_id"], r["b"] or 0) for r in got] == rows
    shard = np.array([r["shard"] for r in got])
    assert (np.diff(shard) >= 0).all() and shard.max() < h.LEAST_SHARDS and len(np.unique(shard)) > h.LEAST_SHARDS // 2
    below = np.concatenate([[0], np.cumsum([max(1, b) for _, b in rows])])  # bytes of the first i rows
    for i in range(1, h.LEAST_SHARDS):
        goal, at = below[-1] * i / h.LEAST_SHARDS, below[np.searchsorted(shard, i)]
        assert abs(at - goal) <= max(h.TOLERANCE * below[-1] / h.LEAST_SHARDS, np.abs(below - goal).min()) + 1e-6


def test_a_partition_may_hold_several_shards(spark):
    df = table(spark, [prose(i, 5 + i % 50) for i in range(500)], ids=[(i * 7919) % 100_003 for i in range(500)])
    few = h.histogram_sort(df, 10, partitions=3)
    assert few.rdd.getNumPartitions() == 3 and few.select("shard").distinct().count() == 10
    assert [tuple(r) for r in few.select("shard", "doc_id").collect()] == [tuple(r) for r in h.histogram_sort(df, 10).select("shard", "doc_id").collect()]


def test_sharding_awkward_rows(spark):
    df = clashing(table(spark, ["x" * 10, None, "", "y" * 10, "z" * 10], ids=[5, None, 5, 5, -3]), "shard", "key", "bytes", "bin")
    got = shards_of(df, 3)
    assert got[0][:2] == (0, None) and {g[0] for g in got if g[1] == 5} == {next(g[0] for g in got if g[1] == 5)} and len(got) == 5
    one = h.histogram_sort(table(spark, ["a", "b"], ids=[7, 7]), 4)
    assert one.count() == 2 and one.select("shard").distinct().count() == 1
    assert h.histogram_sort(df.limit(0), 4).count() == 0 and set(df.columns) == set(h.histogram_sort(df, 2).columns)
    assert h.histogram_sort(df, shard_bytes=8).select("shard").distinct().count() >= 2
    assert h.histogram_sort(df, 1).select("shard").distinct().collect()[0][0] == 0
