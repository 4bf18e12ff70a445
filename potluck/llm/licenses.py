"""Licence scan: ordered signature rules behind a keyword prefilter.

An Aho-Corasick pass over the lower-cased text finds which literals occur; only the regexes whose
literals all do run. A rule's literals are read from its pattern, which cannot match without them. Overlapping detections are resolved by priority and interval containment.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from re import _parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_rules import TABLE

Detection = tuple[int, int, int, int]  # start, end, priority, rule


@cache
def rules() -> list[tuple[str, int, str, re.Pattern]]:
    out = []
    for line in TABLE.strip().splitlines():
        keyword, priority, name, pattern = line.split("|", 3)
        out.append((keyword, int(priority), name, re.compile(pattern.replace("[- ]", r"(?:-|\s+)").replace(" ?", r"\s*").replace(" ", r"\s+"), re.IGNORECASE | re.DOTALL)))
    return out


def literals(pattern: re.Pattern) -> list[str]:
    """Stretches of characters, in lower case, that every match of the pattern has."""
    out = [""]

    def walk(items) -> None:
        for op, value in items:
            if op is _parser.LITERAL:
                out[-1] += chr(value).lower()
            elif op is _parser.SUBPATTERN:
                walk(value[-1])
            elif op is not _parser.AT:
                out.append("")

    walk(_parser.parse(pattern.pattern, pattern.flags))
    return [x for x in out if x]


@cache
def needed() -> list[list[str]]:
    """Per rule its two longest literals, or one where they are short."""
    out = []
    for *_, pattern in rules():
        some = sorted(set(literals(pattern)), key=len, reverse=True)
        out.append(some[:1] + [x for x in some[1:2] if len(x) > 4])
    return out


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for part in {x for some in needed() for x in some}:
        a.add_word(part, part)
    a.make_automaton()
    return a


def candidates(text: str) -> list[int]:
    """The rules whose literals occur in the text."""
    if not text.isascii():
        # characters that patterns take for an i or s in spite of their lower case
        text = text.replace("\u0130", "i").replace("\u0131", "i").replace("\u017f", "s")
    there = {part for _, part in automaton().iter(text.lower())}
    return [i for i, some in enumerate(needed()) if there.issuperset(some)] if there else []


def resolve(found: list[Detection]) -> list[Detection]:
    """Best first (priority, length, position, rule order); one that lies within a better one is suppressed.

    The farthest end of what is kept is held per range of starts (a Fenwick tree of maxima), so n detections take n log n steps.
    """
    starts = sorted({d[0] for d in found})
    far = [-1] * (len(starts) + 1)
    kept: list[Detection] = []
    for d in sorted(found, key=lambda d: (-d[2], d[0] - d[1], d[0], d[3])):
        place = bisect_left(starts, d[0]) + 1
        i, most = place, -1
        while i:
            most = max(most, far[i])
            i &= i - 1
        if most >= d[1]:
            continue
        kept.append(d)
        i = place
        while i < len(far):
            far[i] = max(far[i], d[1])
            i += i & -i
    return sorted(kept)


def detect(text: str) -> list[Detection]:
    every = rules()
    return resolve([(m.start(), m.end(), every[i][1], i) for i in candidates(text) for m in every[i][3].finditer(text)])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    every = rules()
    for batch in batches:
        at, found = [], []
        for row, value in enumerate(batch.column(1)):
            text = value.as_py()
            if text:
                hits = detect(text)
                at += [row] * len(hits)
                found += hits
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(at, pa.int64())),
                pa.array([d[0] for d in found], pa.int64()),
                pa.array([d[1] for d in found], pa.int64()),
                pa.array([every[d[3]][2] for d in found], pa.string()),
                pa.array([d[2] for d in found], pa.int32()),
                pa.array([d[3] for d in found], pa.int32()),
            ],
            names=["doc_id", "start", "end", "license", "priority", "rule"],
        )


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, license, priority, rule): the detections left after suppression, offsets in characters.

    Detections are taken in the order of priority, then length, position and rule number (so a
    tie goes to the earlier rule); one whose interval lies within a better one's is dropped,
    one that only overlaps it stays.

    A null or empty text has no detections; a null id stays null; repeated rows give repeated
    detections; texts of any length are scanned whole; other columns are not read.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _scan, "doc_id long, start long, end long, license string, priority int, rule int"
    )
