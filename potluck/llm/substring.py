"""Substring dedup by sorted suffixes.

Of every `window` consecutive k-word hashes the least one is an anchor, so any passage of
k + window - 1 = `least` words shared by two documents shares an anchor; only passages whose anchor
two documents have are looked at. Each of their places is a start; starts with equal next `least`
words are a group. In a group where not all starts follow one word the suffixes are sorted, and
neighbours have the longest common beginnings, so each start gets its longest match with any other
document. Per document the repeats that lie within no longer one are kept.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import GOLDEN, MIX1, U64, Words, chunks, drop_cut, int64, lean, mix, utf8
from .common import cut as written

LEAST, K = 50, 17
#: Starts, and bytes of suffixes, that about leave a worker together.
BATCH_STARTS, BATCH_BYTES = 1 << 18, 1 << 23
#: Places of a group beyond which its equal suffixes are counted first.
CROWD = 1000

#: Suffixes of one text overlap: zstd takes less disk for them, and no buffers of whole pages.
cut = partial(written, codec="zstd")


def word_hashes(batch_column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, bounds of each row's words) for chunks of a text column."""
    data, offsets = utf8(batch_column)
    for lo, hi in chunks(offsets):
        part = offsets[lo : hi + 1]
        w = Words(data[part[0] : part[-1]], part - part[0])
        yield lo, w.hashes(), w.first


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i:i + k] for every i up to len - k."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.zeros(n, U64)
    for j in range(k):
        h = h * MIX1 + words[j : j + n]
    return mix(h + GOLDEN)


def sliding_min(x: np.ndarray, window: int) -> np.ndarray:
    """Least of x[i:i + window] for every i, by doubling."""
    out, span = x.copy(), 1
    while span * 2 <= window:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    if span < window:
        d = window - span
        out = np.minimum(out[: len(out) - d], out[d:])
    return out


def sliding_argmin(x: np.ndarray, window: int) -> np.ndarray:
    """Place of the least of x[i:i + window] for every i, the leftmost of equal ones."""

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(x[b] < x[a], b, a)

    out, span = np.arange(len(x)), 1
    while span * 2 <= window:
        out = better(out[: len(out) - span], out[span:])
        span *= 2
    if span < window:
        d = window - span
        out = better(out[: len(out) - d], out[d:])
    return out


def winnow(h: np.ndarray, first: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors among words and the document of each.

    h[i] is the hash of the k words from i on, wherever they end; first are the documents' bounds. Of
    equal least hashes in a window the leftmost is chosen, so equal windows have their anchor at the same place.
    """
    n = len(h)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    last = first[1:][doc] - k  # the last position whose k words are in the document
    place = sliding_argmin(h, window)
    start = np.arange(len(place))
    pos = np.unique(place[start + window - 1 <= last[: len(place)]])
    return pos, doc[pos]


def left_contexts(words: np.ndarray, pos: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """63-bit hash of the `size` words before each position, -1 where the document begins within them."""
    h = np.zeros(len(pos), U64)
    for j in range(1, size + 1):
        h = h * MIX1 + words[np.maximum(pos - j, 0)]
    return np.where(pos - size >= begin, (mix(h + GOLDEN) >> U64(1)).astype(np.int64), -1)


def short_hashes(words: np.ndarray) -> np.ndarray:
    """The 32 bits of each word's hash that are kept."""
    return (words >> U64(32)).astype(np.uint32)


def _anchors(k: int, window: int):
    """(h, doc_id, unit, before): the different anchors of every text with the hash of the `window` words before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, units = batch.column(0), batch.column(2)
            for lo, words, first in word_hashes(batch.column(1)):
                x = short_hashes(words).astype(U64)
                h = rolling(x, k)
                pos, doc = winnow(h, first, k, window)
                before = left_contexts(x, pos, first[:-1][doc], window)
                order = np.lexsort((before, h[pos], doc))
                doc, key, before = doc[order], h[pos][order], before[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (before[1:] != before[:-1])
                at = int64(lo + doc[new])
                yield pa.RecordBatch.from_arrays([int64(key[new]), ids.take(at), units.take(at), pa.array(before[new])], names=["h", "doc_id", "unit", "before"])

    return run


def _hasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, unit, 32-bit hash of every word)."""
    for batch in batches:
        for lo, words, first in word_hashes(batch.column(1)):
            short = (words >> U64(32)).astype(np.uint32)
            n = len(first) - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, n), batch.column(2).slice(lo, n), pa.array([short[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())],
                names=["doc_id", "unit", "words"],
            )


def covered(x: np.ndarray, anchors: np.ndarray, least: int, k: int) -> np.ndarray:
    """For every start of `least` words in x whether their anchor is one of those given."""
    if len(x) < least:
        return np.zeros(0, bool)
    return np.isin(sliding_min(rolling(x.astype(U64), k), least - k + 1), anchors)


def _starts(least: int, k: int):
    """(g, doc_id, unit, pos, before): the places of a text that may start a maximal repeat, g is the hash of
    the next `least` words and before the word in front, -1 where the document begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            n = 0
            for i, (doc, unit) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                x = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint32)
                pos = np.flatnonzero(covered(x, np.asarray(batch.column(4)[i].values).view(U64), least, k))
                before = np.where(pos > 0, x[pos - 1].astype(np.int64), -1)
                parts.append((rolling(x.astype(U64), least)[pos], np.full(len(pos), doc), np.full(len(pos), unit), pos.astype(np.int32), before))
                n += len(pos)
                if n >= BATCH_STARTS:
                    yield packed(parts)
                    parts, n = [], 0
            if n:
                yield packed(parts)

    def packed(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == U64 else c) for c in map(np.concatenate, zip(*parts))], names=["g", "doc_id", "unit", "pos", "before"])

    return run


def leads(x: np.ndarray, pos: np.ndarray, least: int) -> np.ndarray:
    """How many words from each of pos on keep the least period of the next `least` ones; `least` where they have none up to its half."""
    out, free = np.full(len(pos), least, np.int64), np.ones(len(pos), bool)
    for p in range(1, least // 2 + 1):
        differ = np.append(np.flatnonzero(x[p:] != x[:-p]), len(x) - p)
        ahead = differ[np.searchsorted(differ, pos)] - pos
        mine = free & (ahead >= least - p)
        out[mine] = ahead[mine] + p
        free &= ~mine
    return out


def _suffixes(least: int, k: int):
    """(g, m, rest, doc_id, unit, pos, hot, lone) for starts: the suffix is its first m words, which g and m tell, and then rest.

    A suffix ends where the covered starts end, as no match goes on. The words of a run of one period
    are told by their number, so long runs do not give long suffixes at each of their places. hot comes with the
    start; lone tells that the document has no other start in the group.
    """

    names = ["g", "m", "rest", "doc_id", "unit", "pos", "hot", "lone"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, bytes, int, int, int, bool, bool]] = []
            size = 0
            for i, (doc, unit) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                x = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint32)
                at = batch.column(4)[i].values
                pos, hot = at.field(0).to_numpy().astype(np.int64), at.field(1).to_numpy(zero_copy_only=False)
                order = np.argsort(pos)
                pos, hot = pos[order], hot[order]
                inside = covered(x, np.asarray(batch.column(3)[i].values).view(U64), least, k)
                gaps = np.append(np.flatnonzero(~inside), len(inside))
                end = gaps[np.searchsorted(gaps, pos)] + least - 1
                m = np.minimum(leads(x, pos, least), end - pos)
                g = rolling(x.astype(U64), least)[pos].view(np.int64)
                _, which, times = np.unique(g, return_inverse=True, return_counts=True)
                lone = (times[which] == 1) & (not batch.column(5)[i].as_py())
                data = x.tobytes()
                for h, p, n, e, crowd, single in zip(g.tolist(), pos.tolist(), m.tolist(), end.tolist(), hot.tolist(), lone.tolist()):
                    rows.append((h, n, data[4 * (p + n) : 4 * e], doc, unit, p, crowd, single))
                    size += 4 * (e - p - n) + 100
                    if size >= BATCH_BYTES:
                        yield packed(rows)
                        rows, size = [], 0
            if rows:
                yield packed(rows)

    def packed(rows: list[tuple[int, int, bytes, int, int, int, bool, bool]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=names)

    return run


def common(a: bytes, b: bytes) -> int:
    """Words (of 4 bytes) that a and b begin with alike."""
    n = min(len(a), len(b)) & ~3
    if a[:n] == b[:n]:
        return n // 4
    lo, step = 0, 256
    while a[lo : lo + step] == b[lo : lo + step]:
        lo, step = lo + step, step * 2
    part = np.frombuffer(a[lo : min(lo + step, n)], np.uint32) != np.frombuffer(b[lo : min(lo + step, n)], np.uint32)
    return lo // 4 + int(part.argmax())


class Node:
    """A stretch of sorted suffixes that have `depth` words in common."""

    __slots__ = ("depth", "first", "twice", "least", "second", "open")

    def __init__(self, depth: int, first: int):
        self.depth, self.first = depth, first
        self.twice = 0  # suffixes whose document is in the stretch already
        self.least: int | None = None  # the two least documents
        self.second: int | None = None
        self.open: list[int] = []  # suffixes without an answer

    def add(self, doc: int | None) -> None:
        if doc is None or doc == self.least or doc == self.second:
            return
        if self.least is None or doc < self.least:
            self.least, self.second = doc, self.least
        elif self.second is None or doc < self.second:
            self.second = doc

    def take(self, other: Node) -> None:
        self.twice += other.twice
        self.add(other.least)
        self.add(other.second)
        if len(self.open) < len(other.open):
            self.open, other.open = other.open, self.open
        self.open += other.open


Entry = tuple[int, int, int | None, int | None, int]


def stretches(entries: list[Entry], depths: list[int]) -> list[tuple[int, int, int, int] | None]:
    """For each of some sorted suffixes its longest beginning that two documents have: (words, the two least such documents, number of them).

    An entry is (documents, the two least of them, the document if it may come again in another entry, words of the suffix);
    depths[i] is what suffixes i - 1 and i have in common. The stretches with a common beginning are gone
    through as a tree from the leaves up; the first with a second document answers.
    """
    out: list[tuple[int, int, int, int] | None] = [None] * len(entries)
    upto = [0, *accumulate(e[0] for e in entries)]
    seen: dict[int, int] = {}
    stack: list[Node] = []

    def close(node: Node, end: int) -> None:
        if node.second is not None:
            answer = (node.depth, node.least, node.second, upto[end] - upto[node.first] - node.twice)
            for j in node.open:
                out[j] = answer
            node.open = []

    for i in range(len(entries) + 1):
        depth = depths[i] if 0 < i < len(entries) else 0
        last: Node | None = None
        while stack and (i == len(entries) or stack[-1].depth > depth):
            node = stack.pop()
            if last is not None:
                node.take(last)
            close(node, i)
            last = node
        if i == len(entries):
            break
        if last is not None:
            if stack and stack[-1].depth == depth:
                stack[-1].take(last)
            else:
                node = Node(depth, last.first)
                node.take(last)
                stack.append(node)
        _, least, second, again, words = entries[i]
        leaf = Node(words, i)
        leaf.add(least)
        leaf.add(second)
        leaf.open.append(i)
        if again is not None:
            before = seen.get(again)
            if before is not None and stack:
                # the least stretch with both holds the document twice
                stack[bisect_right(stack, before, key=lambda s: s.first) - 1].twice += 1
            seen[again] = i
        if stack and stack[-1].depth == words:
            stack[-1].take(leaf)  # the same suffix again
        else:
            stack.append(leaf)
    return out


def longest(docs: list[int], depths: list[int]) -> list[tuple[int, int, int] | None]:
    """For suffixes of one document each: (words, the least other document, number of others)."""
    found = stretches([(1, d, None, d, 1 << 62) for d in docs], depths)
    return [a and (a[0], a[2] if d == a[1] else a[1], a[3] - 1) for d, a in zip(docs, found)]


def _matcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, unit, start_word, end_word, other_doc_id, n_others) of suffixes that come sorted by g, m and rest."""
    group: int | None = None
    docs: list[int] = []
    at: list[tuple[int, int]] = []
    depths: list[int] = []
    m_before, rest_before = 0, b""

    def answers() -> list[tuple[int, int, int, int, int, int]]:
        if not docs or min(docs) == max(docs):
            return []
        return [(d, u, p, p + a[0], a[1], a[2]) for d, (u, p), a in zip(docs, at, longest(docs, depths)) if a]

    names = ["doc_id", "unit", "start_word", "end_word", "other_doc_id", "n_others"]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(6)], names=names)
    for batch in batches:
        rows: list[tuple[int, int, int, int, int, int]] = []
        for g, m, rest, doc, unit, pos in zip(*(c.to_pylist() for c in batch.columns)):
            if g != group:
                rows += answers()
                group, docs, at, depths = g, [], [], []
            depths.append((m + common(rest_before, rest) if m == m_before else min(m, m_before)) if docs else 0)
            docs.append(doc)
            at.append((unit, pos))
            m_before, rest_before = m, rest
        yield pack(rows)
    yield pack(answers())


def _crowd_matcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, m, rest, r1, r2, n, least, second, doc_id, unit, pos) that come sorted by g, m and rest, with (words, first, other, holders) of each.

    A row without doc_id stands for the n documents that have its suffix and no other of the group. Of the suffixes only the last is held.
    """
    names = ["g", "m", "r1", "r2", "doc_id", "unit", "pos", "words", "first", "other", "holders"]
    rows: list[tuple] = []
    entries: list[Entry] = []
    depths: list[int] = []
    m_before, rest_before = 0, b""

    def pack() -> pa.RecordBatch:
        out = [(*r, *a) for r, a in zip(rows, stretches(entries, depths)) if a]
        return pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(len(names))], names=names)

    for batch in batches:
        for g, m, rest, r1, r2, n, least, second, doc, unit, pos in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and rows[-1][0] != g:
                yield pack()
                rows, entries, depths = [], [], []
            depths.append((m + common(rest_before, rest) if m == m_before else min(m, m_before)) if rows else 0)
            rows.append((g, m, r1, r2, doc, unit, pos))
            entries.append((n, least, second, doc, m + len(rest) // 4))
            m_before, rest_before = m, rest
    if rows:
        yield pack()


def _crowded(suffixes: DataFrame) -> DataFrame:
    """The matches of groups that many documents share. Documents with the same suffix, as those that have one passage, are
    counted before anything is shuffled, so a group costs its different suffixes; the answers go back by a join.
    For that a suffix is known by 128 bits of its hashes."""
    key = ["g", "m", "r1", "r2"]
    known = suffixes.withColumns({"r1": F.xxhash64("rest"), "r2": F.xxhash64(F.lit(1), "rest")})
    alone = known.where("lone")
    counts = alone.groupBy(*key, "rest").agg(F.count(F.lit(1)).alias("n"))
    # Spark keeps the first two rows of each key before the shuffle, too
    place = F.row_number().over(Window.partitionBy(key).orderBy("doc_id"))
    two = alone.select(*key, "doc_id").withColumn("__place", place).where("__place <= 2").groupBy(key).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    none = F.lit(None).cast("long")
    columns = ["g", "m", "rest", "r1", "r2", "n", "least", "second", "doc_id", "unit", "pos"]
    one_each = counts.join(two, key).withColumns({"second": F.when(F.col("n") > 1, F.col("most")), "doc_id": none, "unit": none, "pos": none})
    again = known.where(~F.col("lone")).withColumns({"n": F.lit(1).cast("long"), "least": F.col("doc_id"), "second": none})
    found, _ = cut(
        one_each.select(columns)
        .union(again.select(columns))
        .repartition("g")
        .sortWithinPartitions("g", "m", "rest")
        .mapInArrow(lean(_crowd_matcher), "g long, m long, r1 long, r2 long, doc_id long, unit long, pos long, words long, first long, other long, holders long"),
        BATCH_BYTES,
    )
    shared = found.where("pos is null").drop("doc_id", "unit", "pos").join(alone.select(*key, "doc_id", "unit", "pos"), key)
    every = found.where("pos is not null").unionByName(shared.select(*found.columns))
    return every.select(
        "doc_id",
        "unit",
        F.col("pos").alias("start_word"),
        (F.col("pos") + F.col("words")).alias("end_word"),
        F.when(F.col("doc_id") == F.col("first"), F.col("other")).otherwise(F.col("first")).alias("other_doc_id"),
        (F.col("holders") - 1).alias("n_others"),
    )


def extend(a: np.ndarray, b: np.ndarray, seeds: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Maximal matches (start in a, start in b, words) of at least `least` words through the seeds (position in a, in b)."""
    out: list[tuple[int, int, int]] = []
    reach: dict[int, int] = {}
    for i, j in sorted(set(seeds), key=lambda s: (s[0] - s[1], s[0])):
        if reach.get(i - j, -1) > i:
            continue  # within the match found last on this diagonal
        n = min(len(a) - i, len(b) - j)
        differ = np.flatnonzero(a[i : i + n] != b[j : j + n])
        ahead = int(differ[0]) if len(differ) else n
        m = min(i, j)
        differ = np.flatnonzero(a[i - m : i] != b[j - m : j])
        back = m - 1 - int(differ[-1]) if len(differ) else m
        reach[i - j] = i + ahead
        if ahead + back >= least:
            out.append((i - back, j - back, ahead + back))
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, k: int = K, crowd: int = CROWD) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, other_doc_id, n_others): the maximal repeats of each document.

    A repeat is a run of at least `least` words (letters, digits, underscore; case ignored) that
    another document has too; end_word is exclusive. Of a document's repeats those that lie
    within another one are dropped; of equal ones one row stays, with the least other doc_id and
    the number of other documents that have the passage.

    Repeats inside one document only are not reported. A null id or text, an empty text and one
    with fewer than `least` words have none; rows with the same id are one document, whose equal texts
    count once and whose different texts are each matched whole with all other documents (places
    count within the text); other columns are not read. Texts are matched whole. Groups of more than `crowd`
    places are matched by their different suffixes, with the same result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("unit")).where("doc_id is not null and text is not null")
    one = ["doc_id", "unit"]
    spark = docs.sparkSession
    anchors, at_anchors = cut(base.mapInArrow(lean(_anchors(k, least - k + 1)), "h long, doc_id long, unit long, before long"))
    # anchors that only one document has leave before anything is sorted; a start has its anchor among the next words, so where
    # an anchor has the same words before it everywhere, its starts all follow one word and begin no maximal repeat
    bounds = [f(c).alias(f"{n}_{c}") for c in ("doc_id", "before") for n, f in (("least", F.min), ("most", F.max))]
    several, differ = F.expr("least_doc_id <> most_doc_id"), F.expr("least_before <> most_before or least_before < 0")
    shared = anchors.groupBy("h").agg(*bounds).where(several).select("h", differ.alias("differ"))
    mine = anchors.join(shared, "h").groupBy(one).agg(F.collect_set("h").alias("hs"), F.collect_set(F.when(F.col("differ"), F.col("h"))).alias("edges"))
    mine, at_mine = cut(mine)
    drop_cut(spark, at_anchors)
    words = base.join(mine.select(one), one, "left_semi").select("doc_id", "text", "unit").mapInArrow(lean(_hasher), "doc_id long, unit long, words binary")
    held, at_held = cut(words.groupBy(one).agg(F.min("words").alias("words")).join(mine, one).select(*one, "words", "hs", "edges"))
    drop_cut(spark, at_mine)
    starts, at_starts = cut(held.mapInArrow(lean(_starts(least, k)), "g long, doc_id long, unit long, pos int, before long"))
    # where all starts of a group follow one word, each match goes on to the left: only the others begin a maximal one
    first = starts.groupBy("g").agg(*bounds, F.count(F.lit(1)).alias("n")).where(several & differ).select("g", (F.col("n") > crowd).alias("hot"))
    texts = held.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("texts"))
    chosen, at_chosen = cut(starts.join(first, "g").groupBy(one).agg(F.collect_list(F.struct("pos", "hot")).alias("at")).join(texts, "doc_id", "left"))
    drop_cut(spark, at_starts)
    whole = held.join(chosen, one).select(*one, "words", "hs", "at", F.coalesce("texts", F.lit(False)).alias("texts"))
    suffixes, _ = cut(whole.mapInArrow(lean(_suffixes(least, k)), "g long, m long, rest binary, doc_id long, unit long, pos long, hot boolean, lone boolean"))
    for path in (at_held, at_chosen):
        drop_cut(spark, path)
    each = (
        suffixes.where(~F.col("hot"))
        .select("g", "m", "rest", "doc_id", "unit", "pos")
        .repartition("g")
        .sortWithinPartitions("g", "m", "rest")
        .mapInArrow(lean(_matcher), "doc_id long, unit long, start_word long, end_word long, other_doc_id long, n_others long")
    )
    if not suffixes.where("hot").isEmpty():
        each = each.unionByName(_crowded(suffixes.where("hot")))
    w = Window.partitionBy(one).orderBy("start_word", F.desc("end_word")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        each.withColumn("__far", F.max("end_word").over(w))
        .where(F.col("__far").isNull() | (F.col("end_word") > F.col("__far")))
        .select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_doc_id", "n_others")
    )
