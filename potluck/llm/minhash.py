"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

SuperMinHash (Ertl, 2017) gives every element one permutation of the m slots: the element's
j-th random rank lies in [j, j + 1) and goes to the j-th slot of its permutation. Ranks of an
element are thus correlated and the estimate has lower variance than that of plain MinHash.
All elements of a batch take step j together. After step j no slot that holds a value
below j + 1 can change, so a document whose slots are all full leaves: the early stop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, U64, Words, chunks, cut, drop_cut, fresh, grams, lean, mix, utf8

SLOTS, ROWS_PER_BAND, SHINGLE, THRESHOLD = 128, 4, 2, 0.55
#: Rows of a band that are looked at together, and rows of a larger band that are compared at once with all of its others. Neither changes a result.
CROWD, ASKERS = 4096, 512


def superminhash(elements: np.ndarray, bounds: np.ndarray, m: int = SLOTS) -> np.ndarray:
    """Signatures (documents x m, float64) of the sets elements[bounds[i]:bounds[i + 1]]; inf where a set is empty."""
    docs = len(bounds) - 1
    flat = np.full(docs * m, np.inf)
    owner = np.repeat(np.arange(docs), np.diff(bounds))
    seeds = elements.copy()
    perms: np.ndarray | None = None
    for j in range(m):
        if not len(seeds):
            break
        x = mix(seeds + U64((int(GOLDEN) * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
        rank = (x >> U64(33)).astype(np.float64) * 2.0**-31 + j
        k = j + (((x & U64(0xFFFFFFFF)) * U64(m - j)) >> U64(32)).astype(np.int64)
        if perms is None:
            slot = k
        else:
            rows = np.arange(len(seeds))
            slot = perms[rows, k].astype(np.int64)
            perms[rows, k] = perms[:, j]
            perms[:, j] = slot
        np.minimum.at(flat, owner * m + slot, rank)
        left = np.isinf(flat.reshape(docs, m)).any(axis=1)
        stay = left[owner]
        if not stay.all() or perms is None:
            taken = slot[stay]
            seeds, owner = seeds[stay], owner[stay]
            if perms is None:
                perms = np.tile(np.arange(m, dtype=np.uint16), (len(seeds), 1))
                rows = np.arange(len(seeds))
                perms[rows, taken] = 0
                perms[:, 0] = taken
            else:
                perms = perms[stay]
    return flat.reshape(docs, m)


def compact(signatures: np.ndarray) -> np.ndarray:
    """16 bits of each slot: unequal slots agree by chance once in 65,536."""
    bits = np.ascontiguousarray(signatures, dtype=np.float64).view(U64).copy()
    return (mix(bits) >> U64(48)).astype(np.uint16)


def band_hashes(signatures: np.ndarray, rows: int) -> np.ndarray:
    docs, m = signatures.shape
    bands = m // rows
    parts = signatures[:, : bands * rows].astype(U64).reshape(docs, bands, rows)
    h = np.broadcast_to(np.arange(bands, dtype=U64) * GOLDEN, (docs, bands)).copy()
    for r in range(rows):
        h = mix(h * U64(0x2545F4914F6CDD1D) + parts[:, :, r])
    return h


def _signer(slots: int, shingle: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0)
            for lo, hi in chunks(offsets):
                part = offsets[lo : hi + 1]
                words = Words(data[part[0] : part[-1]], part - part[0])
                h, bounds = grams(words.hashes(), words.first, shingle)
                some = np.diff(bounds) > 0
                small = compact(superminhash(h, bounds, slots)[some])
                whole = mix((small.astype(U64) * (np.arange(slots, dtype=U64) * GOLDEN + U64(1))).sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo).filter(pa.array(some)),
                        pa.array(whole.view(np.int64)),
                        pa.array([row.tobytes() for row in small], pa.binary()),
                    ],
                    names=["doc_id", "sig_hash", "sig"],
                )

    return sign


def _bander(slots: int, rows: int):
    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, slots)
            h = band_hashes(sigs, rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), h.shape[1]))],
                names=["band", "doc_id"],
            )

    return band


def bucket_edges(ids: np.ndarray, sigs: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Edges that connect exactly what all verified pairs of one bucket would connect.

    Rows that agree with the first are linked to it; each other row is compared with every row,
    so no pair is skipped whose link could matter.
    """
    same = (sigs == sigs[0]).sum(axis=1) >= need
    edges = [(int(ids[0]), int(x)) for x in ids[1:][same[1:]]]
    for u in np.flatnonzero(~same):
        hits = np.flatnonzero((sigs == sigs[u]).sum(axis=1) >= need)
        edges += [(int(ids[min(u, v)]), int(ids[max(u, v)])) for v in hits if v != u and (same[v] or v > u)]
    return edges


def _packed(pairs: list[np.ndarray], odd: list[tuple[int, int]]) -> pa.RecordBatch | None:
    """(a, b, band): different edges, and rows without b for (document, band) that the pivot did not take."""
    edges = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *pairs]), axis=0)
    if not len(edges) and not odd:
        return None
    n, m = len(edges), len(odd)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*edges[:, 0].tolist(), *(d for d, _ in odd)], pa.int64()),
            pa.array([*edges[:, 1].tolist(), *[None] * m], pa.int64()),
            pa.array([*[None] * n, *(g for _, g in odd)], pa.int64()),
        ],
        names=["a", "b", "band"],
    )


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(columns, begin of each group and the end, signatures' bytes as the last column) of sorted batches, cut between groups of equal first `keys` columns."""
    held: list[pa.Array] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = batch.columns if held is None else [pa.concat_arrays([x, y]) for x, y in zip(held, batch.columns)]
        new = _begins(now, keys)
        keep = int(new[-1])  # the last group may go on in the next batch
        held = [c.slice(keep) for c in now]
        if keep:
            yield _arrays([c.slice(0, keep) for c in now], new[:-1])
    if held is not None and len(held[0]):
        yield _arrays(held, _begins(held, keys))


def _begins(columns: list[pa.Array], keys: int) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns[:keys]:
        x = c.to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _arrays(columns: list[pa.Array], begin: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(columns[-1].to_pylist()), dtype=np.uint16).reshape(len(columns[-1]), -1)
    return [c.to_numpy(zero_copy_only=False) for c in columns[:-1]], np.append(begin, len(columns[-1])), raw


def _verifier(need: int):
    """Links of (band, part, parts, doc_id, sig) rows that come sorted, the pivot (the band's least document) first in each part.

    A band in one part is settled here. In a part of a crowded band the rows are compared with the pivot, and those it does not take are named.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band, _, parts, ids), bounds, sigs in _grouped(batches, 2):
            begin = bounds[:-1]
            group = np.repeat(np.arange(len(begin)), np.diff(bounds))
            pivot = begin[group]
            good = np.zeros(len(ids), dtype=bool)
            for lo in range(0, len(ids), 8192):
                s = slice(lo, lo + 8192)
                good[s] = (sigs[s] == sigs[pivot[s]]).sum(axis=1) >= need
            mine = good & (np.arange(len(ids)) != pivot)
            edges = [np.stack([ids[pivot[mine]], ids[mine]], axis=1)]
            for g in np.unique(group[~good & (parts == 1)]):
                lo, hi = bounds[g], bounds[g + 1]
                if hi - lo > 2 and (some := bucket_edges(ids[lo:hi], sigs[lo:hi], need)):
                    edges.append(np.array(some, np.int64))
            far = ~good & (parts > 1)
            if (out := _packed(edges, list(zip(ids[far].tolist(), band[far].tolist())))) is not None:
                yield out

    return verify


def _comparer(need: int):
    """Links of (band, block, part, order, doc_id, sig) rows that come sorted: the askers (order 0) with all others of their block and part."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, _, order, ids), bounds, sigs in _grouped(batches, 3):
            edges = []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                first = lo + int(np.count_nonzero(order[lo:hi] == 0))
                for u in range(lo, first):
                    hits = ids[first:hi][(sigs[first:hi] == sigs[u]).sum(axis=1) >= need]
                    hits = hits[hits != ids[u]]
                    edges.append(np.stack([np.minimum(hits, ids[u]), np.maximum(hits, ids[u])], axis=1))
            if (out := _packed(edges, [])) is not None:
                yield out

    return compare


def links(bands: DataFrame, signatures: DataFrame, need: int, crowd: int = CROWD, askers: int = ASKERS) -> DataFrame:
    """(a, b): edges that connect what all verified pairs of documents with a common band would connect.

    A band of more than `crowd` rows is split into parts, each with the band's pivot, so no task holds a hot band. The rows that
    the pivot does not take are asked, in blocks of about `askers`, against every part of their band.
    """
    n = F.count(F.lit(1))
    crowded = bands.groupBy("band").agg(n.alias("n"), F.min("doc_id").alias("pivot")).where("n > 1").select("band", "pivot", F.ceil(F.col("n") / crowd).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    rows = bands.join(crowded, "band").select("band", "doc_id", "parts", F.explode(F.when(F.col("doc_id") == F.col("pivot"), every).otherwise(F.array(part))).alias("part"))
    lined = rows.join(signatures, "doc_id").distinct().select("band", "part", "parts", "doc_id", "sig")
    first = lined.repartition("band", "part").sortWithinPartitions("band", "part", "doc_id").mapInArrow(lean(_verifier(need)), "a long, b long, band long")
    first, _ = cut(first)
    near = first.where("b is not null").select("a", "b").distinct()
    odd = first.where("b is null").select("band", F.col("a").alias("doc_id")).distinct()
    if odd.isEmpty():
        return near
    blocks = odd.groupBy("band").agg(F.ceil(n / askers).cast("int").alias("blocks")).join(crowded, "band").select("band", "parts", "blocks")
    block = F.pmod(F.xxhash64("doc_id", F.lit("block")), F.col("blocks")).cast("int")
    asking = odd.join(blocks, "band").select("band", block.alias("block"), F.explode(every).alias("part"), F.lit(0).alias("order"), "doc_id")
    asked = bands.join(blocks, "band").select("band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part.alias("part"), F.lit(1).alias("order"), "doc_id")
    both = asking.union(asked).join(signatures, "doc_id").distinct().select("band", "block", "part", "order", "doc_id", "sig")
    more = both.repartition("band", "block", "part").sortWithinPartitions("band", "block", "part", "order").mapInArrow(lean(_comparer(need)), "a long, b long, band long")
    return near.union(more.select("a", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Union-find over an edge list (a, b) as alternating large-star and small-star rounds.

    Returns (doc_id, group_id) with the least id of each connected component as group_id. Every
    round is a table in the shared folder, so nothing is held on the driver and a lost executor
    costs one round at most.
    """
    now, path = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    spark = edges.sparkSession
    while True:
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after, fresh = cut(small)
        # done when every node has one parent and no parent has a parent
        many = after.groupBy("u").count().where("count > 1").isEmpty()
        done = many and after.join(after.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
        drop_cut(spark, path)
        now, path = after, fresh
        if done:
            break
    return now.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id")).union(
        now.select(F.col("v").alias("doc_id"), F.col("v").alias("group_id")).distinct()
    )


def near_duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    slots: int = SLOTS,
    rows_per_band: int = ROWS_PER_BAND,
    shingle: int = SHINGLE,
    crowd: int = CROWD,
) -> DataFrame:
    """(doc_id, group_id, keep): the documents that have near copies; keep marks the least doc_id of each group.

    Two documents are near copies if the share of equal signature slots, which estimates the
    Jaccard similarity of their sets of `shingle` lower-cased words, is at least `threshold`.
    Groups are the connected components, whatever `crowd` is. With 32 bands of 4 rows a pair at the threshold is a
    candidate with probability 0.95, one at 0.6 with 0.99; every document is a query.

    Documents with a null id, a null or empty text, or no words have no signature and are in no
    group. Rows that repeat an id count as one document. A text of fewer than `shingle` words
    has one shingle. Other columns, whatever their names, are not read.
    """
    need = int(np.ceil(threshold * slots))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    signed = base.mapInArrow(lean(_signer(slots, shingle)), "doc_id long, sig_hash long, sig binary")
    signed, _ = cut(signed)
    # equal signatures first: exact copies meet in one aggregate, and only one of them goes on
    heads = signed.groupBy("sig_hash").agg(F.min("doc_id").alias("head"))
    exact = signed.select("doc_id", "sig_hash").join(heads, "sig_hash").where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    firsts = signed.join(heads.select("sig_hash", F.col("head").alias("doc_id")), ["sig_hash", "doc_id"], "left_semi").select("doc_id", "sig")
    bands, _ = cut(firsts.mapInArrow(lean(_bander(slots, rows_per_band)), "band long, doc_id long"))
    near = links(bands, firsts, need, crowd)
    groups = components(exact.union(near))
    return groups.select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """The documents without those that near_duplicate_groups would drop; all columns stay."""
    groups = near_duplicate_groups(docs, **parameters)
    name = fresh(docs, "gone")
    gone = groups.where(~F.col("keep")).select(F.col("doc_id").alias(name))
    return docs.join(gone, docs[parameters.get("id_col", "doc_id")] == gone[name], "left_anti")
