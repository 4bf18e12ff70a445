"""A small, lenient DOM on the standard library's tokeniser, with the lookups the recipe operators need.

Nodes carry pre- and post-order numbers, so "inside" is an interval test. Repairs: implied end
tags of p, li, dt, dd, tr, td, th, option and headings' inline children; void elements; stray end
tags are dropped; script and style are left out. A document that breaks off is closed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADERS = tuple(f"h{level}" for level in range(1, 7))
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: An opening tag closes these open elements, up to the nearest of the barriers.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


class Node:
    """An element. Once its tree is built it does not change, so what lookups ask for again and again is kept."""

    __slots__ = ("tag", "attrs", "classes", "children", "parent", "pre", "post", "sib", "_below", "_raw", "_glued", "_class")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.classes = attrs.get("class", "").split()
        self.children: list[Node | str] = []
        self.pre = self.post = self.sib = 0
        self._below: list[Node] | None = None
        self._raw: str | None = None
        self._glued: str | None = None
        self._class: str | None = None

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> list[Node]:
        """Descendants in document order."""
        if self._below is None:
            out = []
            stack = self.elements()[::-1]
            while stack:
                n = stack.pop()
                out.append(n)
                stack += n.elements()[::-1]
            self._below = out
        return self._below

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def texts(self) -> Iterator[str]:
        stack: list[Node | str] = self.children[::-1]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            else:
                stack += x.children[::-1]

    def raw(self) -> str:
        if self._raw is None:
            self._raw = "".join(self.texts())
        return self._raw

    def glued(self, separator: str = "") -> str:
        """Stripped text pieces, blank ones left out."""
        if separator:
            return separator.join(t for t in (x.strip() for x in self.texts()) if t)
        if self._glued is None:
            self._glued = "".join(x.strip() for x in self.texts())
        return self._glued

    def class_text(self) -> str:
        if self._class is None:
            self._class = " ".join(self.classes).lower()
        return self._class

    def following(self) -> list[Node]:
        """Element siblings after this one."""
        if self.parent is None:
            return []
        return [c for c in self.parent.elements() if c.sib > self.sib]

    def next(self) -> Node | None:
        return next(iter(self.following()), None)

    def up(self, *tags: str) -> Node | None:
        n = self.parent
        while n is not None and n.tag not in tags:
            n = n.parent
        return n

    def inside(self, other: Node) -> bool:
        return other.pre < self.pre and self.post < other.post


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]", {}, None)
        self.open = [self.root]
        self.mute = 0

    def _close(self, wanted: set[str], barriers: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in wanted:
                del self.open[i:]
                return
            if tag in barriers:
                return

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("script", "style"):
            self.mute += 1
            return
        if self.mute:
            return
        if tag in ("html", "head", "body") and any(n.tag == tag for n in self.open):
            return
        if tag in _BLOCKS:
            self._close({"p"}, {"td", "th", "li", "div", "section", "article", "table", "blockquote"})
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        n = Node(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].children.append(n)
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style") and not self.mute and self.open[-1].tag == tag:
            self.open.pop()
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.mute = max(0, self.mute - 1)
            return
        if self.mute or tag in VOID:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if not self.mute:
            self.open[-1].children.append(data)


def number(root: Node) -> Node:
    """Give the nodes under root their order numbers and sibling places."""
    counter = 0
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        n, left = stack.pop()
        if left:
            n.post = counter
            counter += 1
            continue
        n.pre = counter
        counter += 1
        stack.append((n, True))
        for i, c in enumerate(n.elements()):
            c.sib = i
        stack += [(c, False) for c in n.elements()[::-1]]
    return root


_NAMED = re.compile(r"&([a-zA-Z][a-zA-Z0-9]*)(;?)")


def _keep_open(m: re.Match) -> str:
    return m[0] if m[2] and m[1] + ";" in html5 else "&amp;" + m[0][1:]


def parse(markup: str | bytes | None) -> Node:
    """The tree of a document. A named entity counts with its semicolon only; one that breaks off is text, as lxml has it."""
    if isinstance(markup, bytes):
        markup = markup.decode("utf-8", errors="replace")
    builder = _Builder()
    builder.feed(_NAMED.sub(_keep_open, markup) if markup and "&" in markup else markup or "")
    builder.close()
    return number(builder.root)


def copy(node: Node, parent: Node | None = None) -> Node:
    """A copy of the nodes from node on, whatever their depth."""
    out = Node(node.tag, node.attrs, parent)
    stack = [(node, out)]
    while stack:
        old, new = stack.pop()
        for c in old.children:
            if isinstance(c, Node):
                twin = Node(c.tag, c.attrs, new)
                new.children.append(twin)
                stack.append((c, twin))
            else:
                new.children.append(c)
    return out


def wrap(nodes: list[Node]) -> Node:
    """A new document with copies of the nodes in its body."""
    root = Node("[document]", {}, None)
    html = Node("html", {}, root)
    body = Node("body", {}, html)
    root.children, html.children = [html], [body]
    body.children = [copy(n, body) for n in nodes]
    return number(root)


def release(*roots: Node) -> None:
    """Take trees that are done with apart, so their memory is free at once instead of when cycles are looked for."""
    for root in roots:
        for n in [root, *root.walk()]:
            n.parent = n._below = None
            n.children = []


def clean_lines(node: Node) -> str:
    """Text pieces one to a line, each stripped, blank lines left out."""
    return "\n".join(x for x in (line.strip() for line in node.glued("\n").splitlines()) if x)


def list_items(node: Node) -> list[str]:
    """Texts of the direct li children, pieces parted by a blank, empty ones left out."""
    return [t for t in (c.glued(" ") for c in node.elements() if c.tag == "li") if t]
