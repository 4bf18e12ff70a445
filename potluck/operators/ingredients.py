"""The ingredient cascade over a section's DOM and text (ING1 to ING10)."""

from __future__ import annotations

import re

from potluck.functions import vocab as v
from potluck.sources.dom import Node, list_items

from .sections import bullets, section_after_header

MEASUREMENT = re.compile(v.MEASUREMENT, re.IGNORECASE)
_LOOSE = re.compile(v.LOOSE_INGREDIENT)
_MARKS, _STEP_NUMBER = ",.:;", re.compile(r"\d+\.")
_LINE_VERBS, _STARTERS = frozenset(v.LINE_VERBS), frozenset(v.LONG_STARTERS)


def _first_word(line: str) -> str:
    first = next(iter(line.split()), "")
    return first.lower().rstrip(_MARKS)


def is_header(line: str) -> bool:
    low = line.lower()
    return 0 < len(line) <= 60 and any(k in low for k in v.TEXT_INGREDIENT_KEYWORDS) and not MEASUREMENT.search(line)


def is_item(line: str) -> bool:
    return 5 <= len(line) <= 150 and bool(MEASUREMENT.search(line)) and _first_word(line) not in _LINE_VERBS


def is_step(line: str) -> bool:
    return len(line) >= 10 and (len(line) > 100 or _first_word(line) in _LINE_VERBS)


def is_loose_item(line: str) -> bool:
    low = line.lower()
    return 3 <= len(line) <= 150 and (bool(_LOOSE.search(low)) or (line[0].isdigit() and any(w in low for w in v.LOOSE_FOODS)))


def from_headed_lines(lines: list[str]) -> str | None:
    """Items under ingredient headers; a step or the next header ends a part."""
    parts: list[tuple[str, list[str]]] = []
    inside = False
    for line in (x.strip() for x in lines):
        if is_header(line):
            parts.append((line, []))
            inside = True
        elif inside and line:
            if is_step(line):
                inside = False
            elif is_item(line):
                parts[-1][1].append(line)
    kept = [(h, items) for h, items in parts if items]
    return "\n\n".join(h + "\n" + bullets(items) for h, items in kept).strip() if kept else None


def from_runs(lines: list[str]) -> str | None:
    """The longest run of item lines; after a line such as "Serves" items need no measurement and a lone one survives a gap."""
    runs: list[list[str]] = []
    run: list[str] = []
    zone = False
    for line in (x.strip() for x in lines):
        if not line:
            continue
        low = line.lower()
        if any(m in low for m in v.ZONE_MARKERS):
            zone = True
            continue
        if _STEP_NUMBER.fullmatch(line) or (len(line) > 50 and _first_word(line) in _STARTERS):
            # what was gathered counts here and, as it is not cleared, once more at the end: the longest is the same
            break
        if is_item(line) or (zone and is_loose_item(line)):
            run.append(line)
        elif len(run) >= 2:
            runs.append(run)
            run = []
        elif not zone:
            run = []
    if len(run) >= 2:
        runs.append(run)
    return bullets(max(runs, key=len)) if runs else None


def from_text(text: str) -> str | None:
    lines = text.split("\n")
    return from_headed_lines(lines) or from_runs(lines)


def from_lists(root: Node) -> str | None:
    for n in root.find("ol", "ul"):
        items = list_items(n)
        if items and sum(bool(MEASUREMENT.search(x)) for x in items) >= max(2, 0.3 * len(items)):
            return bullets(items)
    return None


def from_paragraph_classes(root: Node) -> str | None:
    out = []
    for p in root.find("p"):
        if not set(p.classes) & set(v.PARAGRAPH_CLASSES):
            continue
        t = p.glued()
        low = t.lower()
        heading = any(k in low for k in ("ingredients", "shopping list", "what you need", "you will need", "you'll need"))
        if len(t) >= 3 and not heading and not (low.startswith("for the ") and len(t) < 40):
            out.append(t)
    return bullets(out) if len(out) >= 3 else None


def from_paragraph_runs(root: Node) -> str | None:
    """The first run of three short paragraphs with measurements; paragraphs of other lengths don't end a run."""
    run: list[str] = []
    for t in (p.glued() for p in root.find("p")):
        if not 10 <= len(t) < 150:
            continue
        if MEASUREMENT.search(t):
            run.append(t)
        elif len(run) >= 3:
            break
        else:
            run = []
    return bullets(run) if len(run) >= 3 else None


def legacy_ingredients(root: Node, text: str) -> str | None:
    headed = section_after_header(root, v.INGREDIENT_KEYWORDS)
    if headed and len(headed) > 50:
        return headed
    return from_lists(root) or from_paragraph_classes(root) or from_paragraph_runs(root) or from_text(text)
