import itertools
import re

import numpy as np
import pytest

from potluck.llm import minhash as m
from potluck.llm.common import U64

from .util import clashing, prose, table


def sequential(elements, slots):
    """SuperMinHash one element after another, with the same random ranks."""
    h = [np.inf] * slots
    for e in elements:
        p = list(range(slots))
        for j in range(slots):
            x = int(m.mix(np.array([(int(e) + int(m.GOLDEN) * (j + 1)) & (2**64 - 1)], dtype=U64))[0])
            k = j + (((x & 0xFFFFFFFF) * (slots - j)) >> 32)
            p[j], p[k] = p[k], p[j]
            h[p[j]] = min(h[p[j]], (x >> 33) * 2.0**-31 + j)
    return h


@pytest.mark.parametrize("n", [1, 3, 20, 300])
def test_steps_together_equal_one_element_after_another(n):
    e = np.random.default_rng(n).integers(0, 2**63, n).astype(U64)
    got = m.superminhash(e, np.array([0, n]), 16)[0]
    assert got.tolist() == sequential(e, 16)


def test_estimate_is_unbiased_and_tighter_than_minhash():
    rng, est = np.random.default_rng(7), []
    for _ in range(60):
        e = rng.integers(0, 2**63, 60).astype(U64)
        s = m.superminhash(np.concatenate([e[:40], e[10:50]]), np.array([0, 40, 80]))
        est.append((m.compact(s)[0] == m.compact(s)[1]).mean())
    assert abs(np.mean(est) - 0.6) < 0.02 and np.std(est) < (0.6 * 0.4 / 128) ** 0.5


def test_empty_sets_have_no_value():
    s = m.superminhash(np.zeros(0, U64), np.array([0, 0, 0]), 8)
    assert s.shape == (2, 8) and np.isinf(s).all()


def brute(texts, threshold):
    """Connected components of exact Jaccard similarity of word pairs."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"\w+", (t or "").lower())
        if w:
            sets[i] = set(zip(w, w[1:])) if len(w) > 1 else {w[0]}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    sizes = {}
    for i in sets:
        sizes[root(i)] = sizes.get(root(i), 0) + 1
    return {i: root(i) for i in sets if sizes[root(i)] > 1}


def near(text, every, seed):
    w = text.split()
    for i in np.random.default_rng(seed).choice(len(w), len(w) // every, replace=False):
        w[i] = f"other{seed}x{i}"
    return " ".join(w)


def test_groups_equal_brute_force(spark):
    texts = {i: prose(i, 120) for i in range(60)}
    for i in range(20):
        texts[100 + i] = near(texts[i], 20, i)
    for i in range(40):
        texts[200 + i] = texts[5]
        texts[300 + i] = near(texts[6], 15, 50 + i)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["group_id"] for r in m.near_duplicate_groups(df).collect()}
    assert got == brute(texts, m.THRESHOLD)


def test_awkward_rows(spark):
    long = prose(1, 60_000)
    texts = [None, "", "  \n ", "one", "ONE", "!!!", long, long, prose(2, 50), None]
    df = clashing(table(spark, texts), "sig", "band", "a", "b", "keep", "group_id", "gone", "_gone", "u", "v")
    got = {r["doc_id"]: (r["group_id"], r["keep"]) for r in m.near_duplicate_groups(df).collect()}
    assert got == {3: (3, True), 4: (3, False), 6: (6, True), 7: (6, False)}
    kept = m.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 8, 9]


def test_repeated_and_null_ids(spark):
    df = table(spark, ["a b c d", "a b c d", "a b c d", "x y z w"], ids=[5, 5, None, None])
    assert m.near_duplicate_groups(df).count() == 0
    assert m.drop_near_duplicates(df).count() == 4


def test_empty_table(spark):
    df = table(spark, ["x"]).limit(0)
    assert m.near_duplicate_groups(df).collect() == [] and m.drop_near_duplicates(df).count() == 0


def test_bucket_of_mixed_rows_keeps_every_link():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 65536, (2, 32)).astype(np.uint16)
    sigs = np.stack([base[0], base[1], base[0], base[1]])
    edges = m.bucket_edges(np.array([1, 2, 3, 4]), sigs, 30)
    assert set(edges) == {(1, 3), (2, 4)}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["doc_id"]: r["group_id"] for r in m.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def joined(edges):
    """Node -> least node of its component."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize(("crowd", "askers"), [(4096, 512), (8, 4), (3, 1)])
def test_crowded_bands_lose_no_link(spark, crowd, askers):
    """One band of 90 rows in families of near signatures, split into parts and blocks, against all pairs."""
    rng = np.random.default_rng(2)
    families = rng.integers(0, 65536, (7, 32)).astype(np.uint16)
    sigs = {}
    for i in range(90):
        s = families[rng.integers(0, 7)].copy()
        s[rng.choice(32, 6, replace=False)] = rng.integers(0, 65536, 6)
        sigs[int(i * 3)] = s
    bands = [(1, i) for i in sigs] + [(2, i) for i in list(sigs)[:2]]
    need = 22
    pairs = [(a, b) for a, b in itertools.combinations(sigs, 2) if (sigs[a] == sigs[b]).sum() >= need]
    got = m.links(
        spark.createDataFrame(bands, "band long, doc_id long"), spark.createDataFrame([(i, s.tobytes()) for i, s in sigs.items()], "doc_id long, sig binary"), need, crowd, askers
    ).collect()
    assert {(r["a"], r["b"]) for r in got} <= set(pairs) and joined((r["a"], r["b"]) for r in got) == joined(pairs)


def test_groups_do_not_depend_on_the_size_of_parts(spark):
    texts = [near(prose(i % 4, 80), 12, i) for i in range(120)]
    df = table(spark, texts)
    rows = lambda crowd: sorted(map(tuple, m.near_duplicate_groups(df, crowd=crowd).collect()))
    assert rows(4096) == rows(7) and len(rows(7)) > 100
