"""Documents to candidate sections: section tags, else header splitting; titles by a cascade (DOM4 to DOM9)."""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice

from potluck.functions import vocab as v
from potluck.sources.dom import HEADERS, Node, clean_lines, list_items, wrap

_MARKS = [re.compile(r"\{[^}]+\}"), re.compile(r"\[.*?\]" + r"\(.*?\)")]


def bullets(items: list[str]) -> str:
    return "\n".join("- " + x for x in items)


def clean_title(text: str) -> str:
    """Without {..} marks and [..](..) links."""
    for mark in _MARKS:
        text = mark.sub("", text)
    return text.strip()


def section_after_header(root: Node, keywords: list[str]) -> str | None:
    """Text that follows the first header, paragraph or div in which a keyword occurs and after which there is any."""
    for node in root.find(*HEADERS, "p", "div"):
        text = node.raw().lower()
        for _ in (k for k in keywords if k in text):
            after = node.following()
            if after and after[0].tag in ("ol", "ul"):
                return bullets(list_items(after[0]))
            parts: list[str] = []
            for s in after:
                if s.tag in HEADERS:
                    break
                if s.tag in ("ol", "ul"):
                    parts += list_items(s)
                elif s.tag == "p" and (t := s.glued()):
                    parts.append(t)
            if parts:
                return "\n\n".join(parts)
            break
    return None


def _by_bold(root: Node) -> str | None:
    for tag in ("b", "strong"):
        for node in root.find(tag)[:5]:
            t = node.glued()
            if not 10 <= len(t) <= 100 or (t.isupper() and len(t) > 20):
                continue
            if any(s in t.lower() for s in v.BOLD_SKIPS) or any(c.isdigit() for c in t[:10]):
                continue
            return t
    return None


def _by_short_paragraph(root: Node) -> str | None:
    for p in root.find("p")[:10]:
        t, after = p.glued(), p.next()
        if 10 <= len(t) <= 80 and after is not None and after.tag == "p" and len(after.glued()) > 2 * len(t):
            return t
    return None


def _by_line(root: Node) -> str | None:
    for line in clean_lines(root).split("\n")[:5]:
        if 10 <= len(line) <= 100 and not any(s in line.lower() for s in v.LINE_SKIPS) and not line[0].isdigit():
            return line
    return None


def title_from_content(root: Node) -> str | None:
    section = next(iter(root.find("section")), None)
    named = section.attrs.get("title", "").strip() if section is not None else ""
    return named if len(named) > 3 else _by_bold(root) or _by_short_paragraph(root) or _by_line(root)


def split_level(levels: list[int]) -> int:
    """The header level to split at: the first of 2, 3, 4, 1, 5 that occurs three times, else 3."""
    n = Counter(levels)
    return next((level for level in (2, 3, 4, 1, 5) if n[level] >= 3), 3)


def split_by_headers(root: Node, section_title: str | None = None) -> list[tuple[str, Node]]:
    headers = root.find(*HEADERS[:5])
    if not headers:
        return [(section_title or title_from_content(root) or "Untitled", root)]
    level = split_level([int(h.tag[1]) for h in headers])
    chosen = [h for h in headers if int(h.tag[1]) == level] or headers
    ends = {id(h) for h in chosen}
    beside: dict[int, list[Node]] = {}  # the elements of a parent are listed once, not once per header
    out = []
    for h in chosen:
        title = h.glued()
        if len(title) < 3 or title.isdigit():
            continue
        if id(h.parent) not in beside:
            beside[id(h.parent)] = h.parent.elements()
        body = [h]
        for s in islice(beside[id(h.parent)], h.sib + 1, None):
            if s.tag == h.tag and id(s) in ends:
                break
            body.append(s)
        out.append((title, wrap(body)))
    return out


def split_document(root: Node) -> list[tuple[str, Node]]:
    """(title, section document) of every candidate section; nested section tags give overlapping ones."""
    tagged = [s for s in root.find("section") if s.attrs.get("epub:type") != "part" and len(s.glued()) > 100]
    if not tagged:
        first = next(iter(root.find("section")), None)
        return split_by_headers(root, first.attrs.get("title") if first is not None else None)
    out = []
    for s in tagged:
        heads = (h.glued() for h in s.find(*HEADERS[:5])[:3])
        title = next((t for t in heads if len(t) > 3 and not t.isdigit()), None)
        out.append((title or s.attrs.get("aria-label") or "Untitled", wrap([s])))
    return out
