import re

import numpy as np
import pytest

from potluck.llm import substring as s
from potluck.llm.common import ARROW_BYTES, U64, cut, drop_cut

from .util import clashing, prose, table


def words(t):
    return re.findall(r"\w+", (t or "").lower())


def brute(texts, least):
    """Maximal repeats with every other document, by dynamic programming over all pairs."""
    out = {}
    docs = {i: words(t) for i, t in texts.items()}
    for i, a in docs.items():
        spans = set()
        for j, b in docs.items():
            if i == j:
                continue
            run = [0] * (len(b) + 1)
            for x in range(len(a)):
                new = [0] * (len(b) + 1)
                for y in range(len(b)):
                    if a[x] == b[y]:
                        new[y + 1] = run[y] + 1
                        end = x + 1 == len(a) or y + 1 == len(b) or a[x + 1] != b[y + 1]
                        if end and new[y + 1] >= least:
                            spans.add((x + 1 - new[y + 1], x + 1))
                run = new
        keep = {p for p in spans if not any(q != p and q[0] <= p[0] and p[1] <= q[1] for q in spans)}
        if keep:
            out[i] = keep
    return out


def found(df, least=20, k=8, **more):
    out = {}
    for r in s.repeated_passages(df, least=least, k=k, **more).collect():
        assert r["n_words"] == r["end_word"] - r["start_word"] >= least
        out.setdefault(r["doc_id"], set()).add((r["start_word"], r["end_word"]))
    return out


def test_equals_brute_force(spark):
    shared = [prose(1000 + i, n) for i, n in enumerate((20, 25, 40, 60, 19))]
    texts = {i: prose(i, 60) for i in range(14)}
    for i in range(14):
        a, b = shared[i % 5], shared[(i * 3 + 1) % 5]
        texts[i] = f"{prose(i, 30)} {a} {prose(50 + i, 20)} {b}" if i % 2 else f"{a} {prose(i, 25)}"
    texts[20] = texts[3]
    texts[21] = texts[3] + " " + prose(99, 10)
    texts[22] = prose(77, 70)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert found(df) == brute(texts, 20)


def test_passage_of_the_least_length_is_found_anywhere(spark):
    passage = prose(5, 50)
    texts = [prose(i, 13 * i) + " " + passage + " " + prose(40 + i, 7 * i) for i in range(12)]
    got = found(table(spark, texts), 50, 17)
    assert set(got) == set(range(12))
    got = found(table(spark, [" ".join(t.split()[:-1]) if False else t.replace(passage, " ".join(passage.split()[:49])) for t in texts]), 50, 17)
    assert got == {}  # one word less is none


def test_case_and_marks_do_not_count(spark):
    p = prose(1, 60)
    assert set(found(table(spark, [p, p.upper().replace(" ", ", ")]), 50, 17)) == {0, 1}


def test_many_documents_share_a_passage(spark):
    p = prose(9, 70)
    texts = [prose(i, 19) + f" u{i} " + p for i in range(300)]
    df = table(spark, texts)
    assert found(df, 50, 17) == {i: {(20, 90)} for i in range(300)}


@pytest.mark.parametrize("window", [1, 2, 7, 34])
def test_sliding_minimum_and_winnowing(window):
    rng = np.random.default_rng(window)
    x = rng.integers(0, 2**63, 200).astype(U64)
    assert s.sliding_min(x, window).tolist() == [x[i : i + window].min() for i in range(200 - window + 1)]
    first = np.array([0, 0, 90, 90 + window, 200])
    pos, doc = s.winnow(s.rolling(x, 3), first, 3, window)
    for d in range(4):
        mine = pos[doc == d]
        for i in range(first[d], first[d + 1] - 3 - window + 2):
            assert ((mine >= i) & (mine < i + window)).any()
        assert ((mine >= first[d]) & (mine + 3 <= first[d + 1])).all()


def test_runs_of_few_words_match_on_every_diagonal(spark):
    texts = [prose(1, 30) + " of" * 60 + " x " + prose(2, 9), "y" + " of" * 75 + " z " + prose(3, 30), prose(4, 20) + " q" + " of the" * 40, "r" + " the of" * 31]
    df = table(spark, texts)
    assert found(df, 50, 17) == brute(dict(enumerate(texts)), 50)


def test_near_copies_with_scattered_changes(spark):
    """Copies whose stretches between changes are shared by different groups of them."""
    base, texts = prose(11, 400).split(), {}
    for i in range(12):
        w = list(base)
        for j in np.random.default_rng(i).choice(400, 4, replace=False):
            w[j] = f"new{i}x{j}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    cover = lambda spans: {i: {x for a, b in v for x in range(a, b)} for i, v in spans.items()}
    got, want = cover(found(df, 50, 17)), cover(brute(texts, 50))
    assert sum(len(got.get(i, set()) & w) for i, w in want.items()) >= 0.98 * sum(map(len, want.values()))
    assert all(got[i] <= want[i] for i in got)


def test_extend_skips_covered_seeds():
    a = np.arange(100, dtype=np.uint32)
    b = np.concatenate([np.full(5, 1000, np.uint32), a[10:80]])
    assert s.extend(a, b, [(20, 15), (30, 25), (70, 65)], 50) == [(10, 5, 70)]
    assert s.extend(a, b, [(20, 15)], 71) == []


def test_awkward_rows(spark):
    long = prose(3, 30_000)
    p = prose(4, 60)
    texts = [None, "", "few words", p, p, p + " " + p, long, long]
    df = clashing(table(spark, texts, ids=[0, 1, 2, 3, None, 5, 6, 7]), "h", "pos", "n", "l", "r", "words", "other", "seeds", "a", "b", "start_word", "__far")
    assert found(df, 50, 17) == {3: {(0, 60)}, 5: {(0, 60), (60, 120)}, 6: {(0, 30_000)}, 7: {(0, 30_000)}}
    assert found(table(spark, [p, p], ids=[1, 1]), 50, 17) == {}  # rows with one id are one document
    assert s.repeated_passages(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_an_id_with_several_texts(spark, seed):
    """Each text of a repeated id is matched whole; texts of one id are no repeats of each other."""
    p, q = prose(10 + seed, 60), prose(20 + seed, 55)
    rows = [(1, prose(30 + seed, 70)), (1, prose(40 + seed, 200) + " " + p), (1, q + " x"), (1, "y " + q), (2, f"a {p} b {q}"), (3, p + " " + prose(50 + seed, 5))]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string")
    got = sorted((r["doc_id"], r["start_word"], r["end_word"], r["other_doc_id"], r["n_others"]) for r in s.repeated_passages(df).collect())
    assert got == sorted([(1, 200, 260, 2, 2), (1, 0, 55, 2, 1), (1, 1, 56, 2, 1), (2, 1, 61, 1, 2), (2, 62, 117, 1, 1), (3, 0, 60, 1, 2)])


def test_crowded_groups_give_the_same_rows(spark):
    """Passages of many holders, some twice in a document, in documents with several texts, and runs of one word, with and without counting first."""
    p, q, z = prose(1, 60), prose(2, 75), " of" * 70
    texts = [f"{prose(100 + i, 5 + i % 9)} x{i % 4} {p} y{i % 3} {q if i % 2 else p} {prose(200 + i, 3)} {z if i % 5 == 0 else ''}" for i in range(60)]
    ids = [i if i % 7 else 1000 for i in range(60)]
    df = table(spark, texts + texts[:3], ids=ids + ids[:3])
    rows = lambda crowd: sorted(map(tuple, s.repeated_passages(df, crowd=crowd).collect()))
    assert rows(0) == rows(25) == rows(10**9) and len(rows(0)) > 60


def near_copies(n, length, changes, seed=0):
    base, texts = prose(11 + seed, length).split(), []
    for i in range(n):
        w = list(base)
        for j in np.random.default_rng(1000 * seed + i).choice(length, changes, replace=False):
            w[j] = f"new{i}x{j}"
        texts.append(" ".join(w))
    return texts


def holders(texts, spans):
    """(least other document, number of others) that have the words of each span."""
    docs = [" " + " ".join(words(t)) + " " for t in texts]
    out = {}
    for i, some in spans.items():
        for a, b in some:
            part = " " + " ".join(words(texts[i])[a:b]) + " "
            others = [j for j, d in enumerate(docs) if j != i and part in d]
            out[i, a, b] = (min(others), len(others))
    return out


@pytest.mark.parametrize(("n", "length", "changes", "crowd"), [(40, 300, 4, 1000), (12, 400, 4, 1000), (40, 300, 4, 10), (12, 400, 4, 0)])
def test_all_intervals_of_near_copies(spark, n, length, changes, crowd):
    """Every maximal repeat in one piece, whichever pair of copies has it, and with all of its holders."""
    texts = near_copies(n, length, changes)
    rows = s.repeated_passages(table(spark, texts), crowd=crowd).collect()
    want = {}
    docs = [words(t) for t in texts]
    for i, a in enumerate(docs):  # the copies differ in place only, so matches lie on the main diagonal
        spans = set()
        for j, b in enumerate(docs):
            if i != j:
                same = np.flatnonzero(np.diff(np.concatenate([[0], (np.array(a) == np.array(b)).astype(int), [0]])))
                spans |= {(int(x), int(y)) for x, y in zip(same[::2], same[1::2]) if y - x >= 50}
        want[i] = {p for p in spans if not any(q != p and q[0] <= p[0] and p[1] <= q[1] for q in spans)}
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], set()).add((r["start_word"], r["end_word"]))
    assert got == {i: v for i, v in want.items() if v}
    assert {(r["doc_id"], r["start_word"], r["end_word"]): (r["other_doc_id"], r["n_others"]) for r in rows} == holders(texts, want)


def test_repeated_lines(spark):
    """Lines longer than a run's period and repeated: the true diagonal is found at whatever place in a batch the documents lie."""
    texts = []
    for size, times in ((17, 3), (18, 3), (12, 5), (25, 2), (33, 4), (9, 7)):
        for seed in range(3):
            line = " ".join([prose(100 * size + seed, size)] * times)
            texts += [f"{prose(seed, 7 + 13 * seed)} a{seed} {line} b{seed} {prose(seed + 50, 5)}", f"c{size} {prose(seed + 70, 3 * size + seed)} {line}"]
    assert found(table(spark, texts).coalesce(1), 50, 17) == brute(dict(enumerate(texts)), 50)


def test_longest_beginnings_of_counted_suffixes():
    """Entries that stand for several documents, beside documents with several entries, against all pairs."""
    rng = np.random.default_rng(6)
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for _ in range(400):
        words = [bytes(rng.integers(97, 99, rng.integers(1, 7))) for _ in range(rng.integers(1, 10))]
        singles = {w: sorted(10 + i * 10 + j for j in range(rng.integers(0, 4))) for i, w in enumerate(dict.fromkeys(words))}
        entries = [(w, len(d), d[0], d[1] if len(d) > 1 else None, None) for w, d in singles.items() if d]
        entries += [(w, 1, d, None, d) for w in words for d in [int(rng.integers(0, 3))]]
        entries.sort(key=lambda e: e[0])
        holders = [(w, d) for w, ds in singles.items() for d in ds] + [(w, d) for w, _, d, _, again in entries if again is not None]
        got = s.stretches([(n, a, b, c, len(w)) for w, n, a, b, c in entries], [0, *[common(x[0], y[0]) for x, y in zip(entries, entries[1:])]])
        for (w, n, least, second, again), answer in zip(entries, got):
            mine = {least} if n == 1 else set()  # with several documents every one has another
            most = len(w) if n > 1 else max((common(w, v) for v, d in holders if d not in mine), default=None)
            sharing = sorted({d for v, d in holders if most is not None and common(w, v) >= most})
            assert answer == (None if most is None else (most, sharing[0], sharing[1], len(sharing)))


def test_longest_beginnings():
    rng = np.random.default_rng(5)
    for _ in range(300):
        texts = sorted((bytes(rng.integers(97, 99, rng.integers(1, 9))), int(rng.integers(0, 4))) for _ in range(rng.integers(1, 14)))
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        got = s.longest([d for _, d in texts], [0, *[common(a, b) for (a, _), (b, _) in zip(texts, texts[1:])]])
        for (t, d), answer in zip(texts, got):
            most = max((common(t, u) for u, e in texts if e != d), default=None)
            holding = {e for u, e in texts if e != d and common(t, u) == most}
            assert answer == (None if most is None else (most, min(holding), len(holding)))


def test_written_tables_in_small_batches_have_all_rows(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows] * b.num_rows, pa.int64()), b.column(0)], names=["n", "id"])

    df = spark.range(3000).selectExpr("id", "repeat('x', 1000) AS t").coalesce(1).mapInArrow(sizes, "n long, id long")
    before = spark.conf.get(ARROW_BYTES, None)
    (few, at), (usual, other) = cut(df, batch_bytes=100_000, codec="zstd"), cut(df)
    assert spark.conf.get(ARROW_BYTES, None) == before
    assert max(r["n"] for r in few.collect()) <= 200 and max(r["n"] for r in usual.collect()) == 3000
    assert sorted(r["id"] for r in few.collect()) == sorted(r["id"] for r in usual.collect()) == list(range(3000))
    for path in (at, other):
        drop_cut(spark, path)
