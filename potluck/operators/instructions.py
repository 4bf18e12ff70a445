"""The instruction cascade over a section's DOM (INS1 to INS11)."""

from __future__ import annotations

import re
from functools import lru_cache

from potluck.functions import vocab as v
from potluck.sources.dom import HEADERS, Node, list_items

from .ingredients import MEASUREMENT
from .sections import section_after_header

_VERBS = re.compile(r"\b(?:" + "|".join(v.COOKING_VERBS) + r")\b", re.IGNORECASE)
_STOP = re.compile(v.STOP_LINE)
_PREFIX = re.compile(v.NARRATIVE_PREFIX, re.IGNORECASE)
_SECTION_HEADS = ["for serving", "for the", "to garnish", "to serve", "you will need", "you'll need"]


# every strategy counts in the same paragraphs
@lru_cache(512)
def verbs(text: str) -> int:
    return len(_VERBS.findall(text.lower()))


@lru_cache(512)
def measurements(text: str) -> int:
    return len(MEASUREMENT.findall(text))


def is_stop(text: str) -> bool:
    return bool(_STOP.match(text.lower().strip()))


def _paragraphs(root: Node, least: int, skip: list[str] | None = None) -> list[tuple[Node, str]]:
    found = ((p, p.glued()) for p in root.find("p"))
    return [(p, t) for p, t in found if len(t) >= least and not any(s in p.class_text() for s in skip or [])]


def _joined(parts: list[str], least: int) -> str | None:
    return "\n\n".join(parts) if len(parts) >= least else None


def by_class(root: Node) -> str | None:
    return _joined([t for p, t in _paragraphs(root, 30) if any(c in p.class_text() for c in v.INSTRUCTION_CLASSES)], 2)


def by_header(root: Node) -> str | None:
    return section_after_header(root, v.INSTRUCTION_KEYWORDS + v.EXTRA_INSTRUCTION_KEYWORDS)


def by_prefix(root: Node) -> str | None:
    return _joined([t for _, t in _paragraphs(root, 50) if _PREFIX.match(t) and verbs(t) >= 2 and measurements(t) <= 2 * verbs(t)], 1)


def by_long_narrative(root: Node) -> str | None:
    out = []
    for _, t in _paragraphs(root, 150, v.NOT_INSTRUCTION_CLASSES):
        n, k = verbs(t), len(t.split())
        if n >= 4 and n / (k / 100.0) >= 1.5 and measurements(t) <= 2 * n:
            out.append(t)
    return _joined(out, 1)


def after_ingredients(root: Node) -> str | None:
    """Paragraphs with verbs once an ingredient heading was seen."""
    out: list[str] = []
    past, heads = False, 0
    for n in root.find("p", *HEADERS):
        text, classes = n.glued().lower(), n.class_text()
        if (len(text) < 50 or "head" in classes or n.tag in HEADERS) and (any(k in text for k in _SECTION_HEADS) or text == "ingredients"):
            heads += 1
            past = False
            continue
        if any(k in text for k in v.INSTRUCTION_KEYWORDS):
            past = True
            continue
        if n.tag != "p" or not heads or any(k in classes for k in ("ingredient", "item", "serv", "time", "yield")) or len(text) < 40:
            continue
        found = verbs(text)
        if found >= 2:
            past = True
            out.append(n.glued())
        elif past and found == 1:
            out.append(n.glued())
            if is_stop(text):
                break
    return _joined(out, 2)


def from_lists(root: Node) -> str | None:
    for n in root.find("ol", "ul"):
        items = list_items(n)
        text = " ".join(items)
        if len(items) >= 2 and len(text) > 100 and verbs(text) >= 3:
            return "\n\n".join(f"{i}. {x}" for i, x in enumerate(items, 1))
    return None


def by_verb_runs(root: Node) -> str | None:
    out: list[str] = []
    started, idle = False, 0
    for _, t in _paragraphs(root, 40, v.NOT_INSTRUCTION_CLASSES):
        n = verbs(t)
        if n >= 2 or (started and n == 1):
            started, idle = True, 0
            out.append(t)
        elif started and len(t) < 100:
            idle += 1
            if idle >= 2:
                break
            out.append(t)
        elif started and (is_stop(t) or len(out) >= 3):
            break
    return _joined(out, 2)


def best_paragraph(root: Node) -> str | None:
    best, top = None, 0
    for _, t in _paragraphs(root, 100, [*v.NOT_INSTRUCTION_CLASSES, "intro"]):
        n = verbs(t)
        if n >= 3 and n > top and measurements(t) <= n:
            best, top = t, n
    return best


CASCADE = (by_class, by_header, by_prefix, by_long_narrative, after_ingredients, from_lists, by_verb_runs, best_paragraph)


def legacy_instructions(root: Node) -> str | None:
    """The first strategy's text that is longer than 100 characters."""
    return next((t for f in CASCADE if (t := f(root)) and len(t) > 100), None)
