"""Pieces the training-data operators share: table access, lineage cuts and vectorised tokenising.

Texts are handled as the UTF-8 buffer of an Arrow column plus offsets, so a whole batch is
tokenised, lower-cased and hashed with numpy and no Python object per word is made.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from potluck.sources.shared import delete, fresh_path

#: Bytes of text that the vectorised operators look at together (a longer document goes alone).
CHUNK_BYTES = 1 << 19

U64 = np.uint64
MIX1, MIX2, GOLDEN = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables that cut has written and that still lie in the shared folder.
_written: list[str] = []


def drop_cut(spark: SparkSession, path: str) -> None:
    """Remove a written table that no later read needs."""
    delete(spark, path)
    if path in _written:
        _written.remove(path)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def cut(df: DataFrame, batch_bytes: int | None = None, codec: str | None = None) -> tuple[DataFrame, str]:
    """Write df once to the shared folder and read it back: lineage ends here and a lost executor loses nothing.

    With batch_bytes, rows go to the Python workers in batches of about so many bytes: their usual bound is a number of
    rows, and the JVM holds a batch outside its heap. codec is that of the Parquet files: zstd works on a stream, where the usual
    one takes buffers of whole pages outside the heap. The table lies there until drop_cut, drop_since or the interpreter's end.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "cut")
    usual = spark.conf.get(ARROW_BYTES, None)
    if batch_bytes is not None:
        spark.conf.set(ARROW_BYTES, str(batch_bytes))
    try:
        df.write.parquet(path, compression=codec)
    finally:
        if batch_bytes is not None:
            spark.conf.set(ARROW_BYTES, usual) if usual is not None else spark.conf.unset(ARROW_BYTES)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def mark() -> int:
    """A place among the written tables, for drop_since."""
    return len(_written)


def drop_since(spark: SparkSession, place: int, keep: str | None = None) -> None:
    """Remove the tables written since a mark, but for one: what they were needed for has been written itself."""
    for path in [p for p in _written[place:] if p != keep]:
        drop_cut(spark, path)


def _trimmer():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library keeps what it likes
        return lambda pad: 0


def release() -> None:
    """Give back to the system what the allocators keep of freed memory: a Python worker stays alive between tasks."""
    pa.default_memory_pool().release_unused()
    _trimmer()(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = 2000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run over slices of at most `rows` rows, with freed memory given back after each batch that came."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                yield batch.slice(lo, rows)
            del batch
            release()

    return lambda batches: run(slices(batches))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place on uint64."""
    x ^= x >> U64(30)
    x *= MIX1
    x ^= x >> U64(27)
    x *= MIX2
    x ^= x >> U64(31)
    return x


def _positions() -> np.ndarray:
    return mix(np.arange(1, 4097, dtype=U64) * GOLDEN) | U64(1)


POSITION = _positions()


def _word_bytes() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[ord("0") : ord("9") + 1] = t[ord("a") : ord("z") + 1] = t[ord("A") : ord("Z") + 1] = True
    t[ord("_")] = True
    t[128:] = True
    return t


#: Bytes of words: ASCII letters, digits, underscore and every byte of a non-ASCII character.
WORD = _word_bytes()
#: Bytes of whitespace-delimited tokens.
INK = np.arange(256) > 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null counts as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes each; every row is in exactly one."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the two-byte capitals U+00C0 to U+00DE; other bytes stay."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        latin = np.zeros(len(data), dtype=bool)
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[latin] += 32
    return out


class Words:
    """The words of some documents: starts, ends (bytes), hash of each, first[i]:first[i + 1] are those of document i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray = WORD, lower: bool = True):
        data = lowered(data) if lower else data
        inside = alphabet[data]
        before = np.empty_like(inside)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
            before[offsets[:-1][offsets[:-1] < len(data)]] = False
        after = np.empty_like(inside)
        if len(data):
            after[-1] = False
            after[:-1] = inside[1:]
            last = offsets[1:][offsets[1:] > 0] - 1
            after[last] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.data, self.offsets = data, offsets

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, U64)
        lengths = self.ends - self.starts
        at = np.arange(lengths.sum(), dtype=np.int64)
        begin = np.cumsum(lengths) - lengths
        within = at - np.repeat(begin, lengths)
        source = within + np.repeat(self.starts, lengths)
        parts = (self.data[source].astype(U64) + U64(1)) * POSITION[within & 4095]
        return mix(np.add.reduceat(parts, begin) + lengths.astype(U64) * GOLDEN)


def grams(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles that stay within a document, and per document their bounds.

    A document of 1 to k - 1 words has one shingle made of all of them; one without words has none.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    bounds = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    start = np.arange(bounds[-1]) - np.repeat(bounds[:-1], count) + first[:-1][doc]
    h = np.zeros(len(start), U64)
    limit = first[1:][doc]
    for j in range(k):
        ok = start + j < limit
        w = np.where(ok, words[np.minimum(start + j, max(0, len(words) - 1))], U64(0)) if len(words) else h
        h = mix(h * MIX1 + w + GOLDEN)
    return h, bounds


def int64(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == U64 else values.astype(np.int64))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def env_path(name: str, default: str) -> str:
    return os.environ.get(name, default)
