"""Histogram sort: splitters refined by exact byte counts, then one exchange.

A narrow table of (key, bytes) is written once. Each round counts in one pass the bytes below
every probe key; the bracket of each wanted boundary shrinks to the probes around it, and new
probes are spread inside the bracket. When each splitter's count is within the tolerance (or its
bracket is a single key), the documents move once, straight to their shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

TOLERANCE, PROBES = 0.01, 32
#: Where no number of shards is given: bytes of text in a shard, and how many shards there are at least.
SHARD_BYTES, LEAST_SHARDS = 32 << 20, 24
#: Partitions of the exchange at most, as it keeps a size for every pair of tasks; beyond it a partition holds several whole shards.
MOST_PARTITIONS = 20_000
#: Most probes of a round; with many boundaries each gets fewer, and more rounds.
MOST_PROBES = 400_000


def _counter(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = shared.value
        total = np.zeros(len(probes) + 1, dtype=np.int64)
        for batch in batches:
            keys, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # a key below or equal to probe i falls in a bin up to i
            np.add.at(total, np.searchsorted(probes, keys, side="left"), size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bin", "bytes"])

    return count


def bytes_up_to(slim: DataFrame, probes: np.ndarray) -> np.ndarray:
    """For each probe the exact bytes of the rows with a key <= it."""
    shared = slim.sparkSession.sparkContext.broadcast(probes)
    rows = slim.mapInArrow(_counter(shared), "bin long, bytes long").groupBy("bin").agg(F.sum("bytes").alias("bytes")).toArrow()
    shared.destroy()
    total = np.zeros(len(probes) + 1, dtype=np.int64)
    total[rows["bin"].to_numpy()] = rows["bytes"].to_numpy()
    return np.cumsum(total)[:-1]


def splitters(slim: DataFrame, shards: int, tolerance: float = TOLERANCE, probes: int = PROBES) -> tuple[np.ndarray, int]:
    """shards - 1 keys, each the last of its shard, and the rounds it took.

    Boundary i is met if the bytes up to its key differ from i/shards of all bytes by at most
    tolerance * all / shards, or if no key lies strictly inside its bracket (a key is never split).
    """
    low, high, total = slim.agg(F.min("key"), F.max("key"), F.sum("bytes")).first()
    if low is None or shards < 2 or not total:
        return np.zeros(0, dtype=np.int64), 0
    goal = total * np.arange(1, shards) / shards
    allowed = tolerance * total / shards
    # the bracket of boundary i: bytes up to lo are below the goal, bytes up to hi reach it
    lo, hi = [low - 1] * (shards - 1), [high] * (shards - 1)
    at_lo, at_hi = np.zeros(shards - 1), np.full(shards - 1, float(total))
    best = np.full(shards - 1, high, dtype=np.int64)
    off = np.abs(at_hi - goal)
    rounds = 0
    while True:
        open_ = [i for i in range(shards - 1) if off[i] > allowed and hi[i] - lo[i] > 1]
        if not open_:
            break
        rounds += 1
        each = max(1, min(probes, MOST_PROBES // len(open_)))
        wanted: set[int] = set()
        for i in open_:
            # one probe where the count would be if bytes lay evenly in the bracket, the others evenly spaced
            guess = lo[i] + round((hi[i] - lo[i]) * float((goal[i] - at_lo[i]) / max(1.0, at_hi[i] - at_lo[i])))
            wanted.add(min(max(guess, lo[i] + 1), hi[i] - 1))
            wanted.update(k for j in range(1, each + 1) if lo[i] < (k := lo[i] + (hi[i] - lo[i]) * j // (each + 1)) < hi[i])
        keys = np.array(sorted(wanted), dtype=np.int64)
        count = bytes_up_to(slim, keys)
        # the counts rise with the keys: the last probe below a goal and the first that reaches it bound its bracket
        first = np.searchsorted(count, goal[open_], side="left")
        for i, f in zip(open_, first.tolist()):
            if f > 0 and keys[f - 1] > lo[i]:
                lo[i], at_lo[i] = int(keys[f - 1]), int(count[f - 1])
            if f < len(keys) and keys[f] < hi[i]:
                hi[i], at_hi[i] = int(keys[f]), int(count[f])
            for k, c in ((lo[i], at_lo[i]), (hi[i], at_hi[i])):
                if abs(c - goal[i]) < off[i] and k >= low:
                    best[i], off[i] = k, abs(c - goal[i])
    return np.maximum.accumulate(best), rounds


def histogram_sort(
    docs: DataFrame,
    shards: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    tolerance: float = TOLERANCE,
    probes: int = PROBES,
    shard_bytes: int = SHARD_BYTES,
    partitions: int = MOST_PARTITIONS,
) -> DataFrame:
    """docs with a column shard (0 to shards - 1), partitioned by shard and ordered by id_col in each.

    Without a number of shards there are as many as make about `shard_bytes` each, and LEAST_SHARDS at least. Shards are
    key ranges of nearly equal UTF-8 bytes of text_col. The shard is found by a binary search in the
    JVM, so the texts cross no Python process. Rows move once; a partition holds one shard, or a range of
    whole shards, one after another, where there would be more than `partitions` of them.

    A null id sorts first, as the smallest long, and so is in shard 0; rows with equal ids stay
    in one shard, whatever the tolerance, so with few ids some shards are empty; a null or empty text weighs one byte, so that the
    table still splits; an empty table gives an empty result; other columns are carried along. A
    column that is already named shard is replaced.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63) + 1).cast("long"))
    slim, _ = cut(docs.select(key.alias("key"), F.greatest(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))), F.lit(1)).cast("long").alias("bytes")))
    if shards is None:
        shards = max(LEAST_SHARDS, -(-(slim.agg(F.sum("bytes")).first()[0] or 0) // shard_bytes))
    cuts, _ = splitters(slim, shards, tolerance, probes)
    rest = docs.drop("shard") if "shard" in docs.columns else docs
    if len(cuts):
        # one text that Catalyst folds to one literal array, however many splitters there are
        bounds = F.split(F.lit(",".join(map(str, cuts.tolist()))), ",").cast("array<bigint>")
        shard = _bisect(bounds, key, len(cuts))
    else:
        shard = F.lit(0)
    placed = rest.withColumn("shard", shard.cast("int"))
    parts = min(shards, partitions)
    part = F.col("shard") if parts == shards else F.floor(F.col("shard").cast("long") * parts / shards).cast("int")
    return placed.repartitionById(parts, part).sortWithinPartitions("shard", F.col(id_col).asc_nulls_first())


def _bisect(bounds, key, n: int):
    """How many of the n ascending bounds lie below key, by a binary search written as a fold over its few steps."""
    steps = F.array(*[F.lit(1 << b) for b in range(n.bit_length() - 1, -1, -1)])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when((at + step <= n) & (F.coalesce(F.get(bounds, at + step - 1), F.lit(2**63 - 1)) < key), at + step).otherwise(at),
    )
