"""Secret scan: sliding-window Shannon entropy per character class, with an allow-list.

Candidates are maximal runs of key-like characters. In every stretch of a candidate that
belongs to one class, a window slides by one character; its counts change by one character in
and one out, and the sum of c * log2(c) changes with them, so a step costs O(1).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, utf8

MIN_LENGTH = 20
#: class -> (its characters, least entropy of a window in bits, must hold a digit and a letter)
CLASSES = {
    "hex": ("0123456789abcdefABCDEF", 2.9, True),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=", 3.75, True),
    "urlsafe": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", 3.75, True),
    # fewer characters have less entropy: a random key's best window of 20 falls below this in up to three of a thousand cases (of 2,000 drawn)
    "upper": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.2, True),
    "lower": ("abcdefghijklmnopqrstuvwxyz0123456789", 3.2, True),
}
#: Key ids whose form tells them, even without a digit.
KEY_ID = r"(?:AKIA|ASIA)[A-Z2-7]{16}"
#: Harmless high-entropy strings, each held against a whole string; every pattern takes time linear in it. What a rule clears is
#: bounded by its form, so a key beside a harmless word stays.
ALLOW = [
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[A-Za-z0-9+/]{0,40}EXAMPLE(?:KEY)?[0-9]{0,4}",
    r"(?i:example|sample|dummy|placeholder|changeme|redacted|your)[-_][^=/+]{0,48}",
    r"[0-9]+(?:[-_/][0-9]+)*",
    rf"(?!{KEY_ID}\Z)[A-Za-z]+(?:[-_/][A-Za-z]+)*",
    r"(?i:0123456789abcdef|0123456789|abcdefghijklmnopqrstuvwxyz|abcdef)+",
]
REPEATED = r"(.{1,16}?)\1{2,}"
#: A step of a path: words of one case or capitalised ones, with a short number at the end, joined by - or _.
STEP = r"(?:[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})*|[A-Z]+|[a-z])?[0-9]{0,4}(?:[-_](?:[A-Za-z]?[a-z]+|[A-Z]+)?[0-9]{0,4})*"
#: Held against what stands before the string.
ALLOW_BEFORE = [r"sha(?:1|256|384|512)[-:= ]+$", r"md5[-:= ]+$", r"(?:commit|tree|blob)[/ ]$", r"base64,$", r"(?i:checksum)[-:= \"']+$"]
CONTEXT = 32
_LOG = [0.0, 0.0] + [c * log2(c) for c in range(2, 4096)]
_KEY_ID = re.compile(KEY_ID)
_ALLOWED = re.compile("|".join(f"(?:{p})" for p in ALLOW))
_REPEATED, _STEP = re.compile(REPEATED), re.compile(STEP)
_ALLOWED_BEFORE = re.compile("|".join(f"(?:{p})" for p in ALLOW_BEFORE))


def _table(characters: str) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[[ord(c) for c in characters]] = True
    return t


_KEYLIKE = _table("".join(sorted(set("".join(c for c, _, _ in CLASSES.values())))))


def window_entropies(s: str, window: int = MIN_LENGTH) -> list[float]:
    """Shannon entropy of every window of s, by incremental counts."""
    counts: dict[str, int] = {}
    total, out = 0.0, []
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _LOG[n + 1] - _LOG[n]
        if i >= window:
            old = s[i - window]
            n = counts[old]
            counts[old] = n - 1
            total += _LOG[n - 1] - _LOG[n]
        if i >= window - 1:
            out.append(log2(window) - total / window)
    return out


def is_path(s: str) -> bool:
    """Three slashes or more, and each step between them looks like a file's or folder's name."""
    return s.count("/") >= 3 and all(_STEP.fullmatch(step) for step in s.split("/"))


def allowed(candidate: str, before: str) -> bool:
    return bool(_ALLOWED.fullmatch(candidate) or _REPEATED.fullmatch(candidate) or is_path(candidate) or _ALLOWED_BEFORE.search(before))


def scan_candidate(candidate: str, before: str = "", window: int = MIN_LENGTH) -> list[tuple[int, int, str, float]]:
    """(start, end, class, greatest entropy) of the class stretches with a hot window; the longest wins where they overlap."""
    if allowed(candidate, before):
        return []
    hits = []
    for rank, (name, (characters, least, mixed)) in enumerate(CLASSES.items()):
        for m in re.finditer(f"[{re.escape(characters)}]{{{window},}}", candidate):
            s = m.group()
            if mixed and not (re.search("[0-9]", s) and re.search("[A-Za-z]", s)) and not _KEY_ID.fullmatch(s):
                continue
            ahead = candidate[max(0, m.start() - CONTEXT) : m.start()]
            if allowed(s, (before + ahead)[-CONTEXT:]):
                continue
            top = max(window_entropies(s, window))
            if top >= least:
                hits.append((m.start(), m.end(), rank, name, top))
    hits.sort(key=lambda h: (h[0] - h[1], h[2], h[0]))
    kept: list[tuple[int, int, str, float]] = []  # disjoint and in order, so only the two neighbours of a hit can overlap it
    for lo, hi, _, name, top in hits:
        at = bisect_left(kept, (lo,))
        if (at == 0 or kept[at - 1][1] <= lo) and (at == len(kept) or kept[at][0] >= hi):
            kept.insert(at, (lo, hi, name, top))
    return kept


def scan_batch(data: np.ndarray, offsets: np.ndarray, window: int = MIN_LENGTH) -> Iterator[tuple[int, int, int, str, float]]:
    """(document, first byte, last byte + 1, class, entropy) of every secret in a batch of texts."""
    step = 1 << 24
    lo_doc = 0
    while lo_doc < len(offsets) - 1:
        hi_doc = min(max(lo_doc + 1, int(np.searchsorted(offsets, offsets[lo_doc] + step, side="right")) - 1), len(offsets) - 1)
        base = int(offsets[lo_doc])
        part = data[base : offsets[hi_doc]]
        inside = np.zeros(len(part) + 2, dtype=np.int8)
        inside[1:-1] = _KEYLIKE[part]
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        local = offsets[lo_doc : hi_doc + 1] - base
        long = ends - starts >= window
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            first = int(np.searchsorted(local, a, side="right")) - 1
            # a run that crosses the end of a document is cut there
            d = first
            while d < len(local) - 1 and local[d] < b:
                x, y = max(a, int(local[d])), min(b, int(local[d + 1]))
                if y - x >= window:
                    s = part[x:y].tobytes().decode("ascii")
                    before = part[max(int(local[d]), x - CONTEXT) : x].tobytes().decode("utf-8", "ignore")
                    for p, q, name, top in scan_candidate(s, before, window):
                        yield lo_doc + d, base + x + p, base + x + q, name, top
                d += 1
        lo_doc = hi_doc


FOUND = "doc_id long, start long, end long, char_class string, entropy double, preview string"


def characters_before(data: np.ndarray, spans: list[tuple[int, int]]) -> list[int]:
    """How many characters begin in each data[lo:hi], in one pass over the bytes."""
    if not spans:
        return []
    cuts = np.unique(np.array(spans))
    total = np.zeros(len(cuts), np.int64)
    lead = ((data[cuts[0] : cuts[-1]] & 0xC0) != 0x80).view(np.uint8)
    if len(lead):
        total[1:] = np.cumsum(np.add.reduceat(lead, cuts[:-1] - cuts[0], dtype=np.int64))
    return (total[np.searchsorted(cuts, [b for _, b in spans])] - total[np.searchsorted(cuts, [a for a, _ in spans])]).tolist()


def _scanner(window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            rows = list(scan_batch(data, offsets, window))
            at = characters_before(data, [(int(offsets[d]), a) for d, a, _, _, _ in rows])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                    pa.array(at, pa.int64()),
                    pa.array([s + r[2] - r[1] for s, r in zip(at, rows)], pa.int64()),
                    pa.array([r[3] for r in rows], pa.string()),
                    pa.array([round(r[4], 6) for r in rows], pa.float64()),
                    pa.array([data[r[1] : r[1] + 4].tobytes().decode("ascii") + "..." for r in rows], pa.string()),
                ],
                names=["doc_id", "start", "end", "char_class", "entropy", "preview"],
            )

    return scan


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, start, end, char_class, entropy, preview): one row per secret, offsets in characters.

    A secret is a stretch of at least `window` characters of one class with a window whose
    entropy reaches the class's least value, unless the allow-list names it or what stands
    before it. Only its first four characters are shown.

    A null or empty text has no findings; a null id stays null in its findings; repeated rows
    give repeated findings; texts of any length are scanned whole; other columns are not read.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(_scanner(window)), FOUND)


def _redactor(window: int, mark: bytes):
    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            data, offsets = utf8(column)
            found: dict[int, list[tuple[int, int]]] = {}
            for d, a, b, _, _ in scan_batch(data, offsets, window):
                found.setdefault(d, []).append((a, b))
            if not found:
                yield batch
                continue
            # rows without a finding stay where they are; only the others are written anew
            pieces, lo = [], 0
            for d, spans in sorted(found.items()):
                parts, at = [], int(offsets[d])
                for a, b in sorted(spans):
                    parts += [data[at:a].tobytes(), mark]
                    at = b
                text = b"".join([*parts, data[at : offsets[d + 1]].tobytes()])
                pieces += [column.slice(lo, d - lo), pa.array([text], pa.binary()).cast(column.type)]
                lo = d + 1
            pieces.append(column.slice(lo))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(pieces), *batch.columns[1:]], schema=batch.schema)

    return redact


def redact_secrets(docs: DataFrame, text_col: str = "text", window: int = MIN_LENGTH, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text_col replaced by `mark`; all rows, columns and nulls stay."""
    rest = [c for c in docs.columns if c != text_col]
    out = docs.select(text_col, *rest).mapInArrow(lean(_redactor(window, mark.encode())), docs.select(text_col, *rest).schema)
    return out.select(*docs.columns)
