"""A document tree on the standard library's HTML parser, with the repairs that pages need most.

Void elements never open; paragraphs, list items, cells, rows and options end where the next
one begins; raw-text elements keep their text; unclosed elements end with their parent.
"""

from __future__ import annotations

import html
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
RAW = frozenset(("script", "style"))
#: An opening tag ends an open element of the first set, unless one of the second set lies between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
_ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
_PARAGRAPH_WALLS = frozenset(("button", "td", "th", "table", "object", "body", "html", "li", "div", "section", "article", "blockquote", "figure", "form", "aside", "main"))


class Node:
    """An element (tag set) or a text (tag None)."""

    __slots__ = ("attrs", "children", "parent", "tag", "text")

    def __init__(self, tag: str | None, attrs: dict | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None

    def get(self, name: str, default: str = "") -> str:
        value = self.attrs.get(name, default)
        return value if value is not None else ""

    def append(self, child: Node) -> None:
        child.parent = self
        self.children.append(child)

    def remove(self) -> None:
        if self.parent is not None:
            siblings = self.parent.children
            if siblings and siblings[-1] is self:
                siblings.pop()
            else:
                self.parent.children = [c for c in siblings if c is not self]
            self.parent = None

    def walk(self) -> Iterator[Node]:
        """This node and all below it in document order, without recursion."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def elements(self) -> Iterator[Node]:
        return (n for n in self.walk() if n.tag and n is not self)

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def text_content(self) -> str:
        return "".join(n.text for n in self.walk() if n.tag is None)

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.elements() if n.tag in tags), None)

    def next_element(self) -> Node | None:
        if self.parent is None:
            return None
        seen = False
        for sibling in self.parent.children:
            if seen and sibling.tag:
                return sibling
            seen = seen or sibling is self
        return None


class _Builder(HTMLParser):
    """Builds the tree; where each tag is open is kept by tag, so that elements open at any depth cost no search."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "head", "body") and self.places.get(tag):
            existing = self.open[self.places[tag][0]]
            for key, value in attrs:
                existing.attrs.setdefault(key, value)
            return
        if tag == "body":
            self._close_to("head")
        if tag in _ENDS_PARAGRAPH:
            self._end(("p",), _PARAGRAPH_WALLS)
        if tag in _ENDS:
            self._end(*_ENDS[tag])
        node = Node(tag, dict(attrs))
        self.open[-1].append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag):
        self._close_to(tag)

    def handle_data(self, data):
        if data:
            self.open[-1].append(Node(None, text=data))

    def _cut(self, depth: int) -> None:
        """Close all elements from ``depth`` on."""
        while len(self.open) > depth:
            self.places[self.open.pop().tag].pop()

    def _close_to(self, tag: str) -> None:
        if self.places.get(tag):
            self._cut(self.places[tag][-1])

    def _end(self, tags, walls) -> None:
        """Close the outermost open element of ``tags`` above the nearest wall, and all within it."""
        wall = max((at[-1] for w in walls if w not in tags and (at := self.places.get(w))), default=0)
        above = [at[k] for t in tags if (at := self.places.get(t)) and (k := bisect_right(at, wall)) < len(at)]
        if above:
            self._cut(min(above))


def parse(source: str | None) -> Node:
    """The tree of a page; always has a body. A fragment's nodes are its body's."""
    builder = _Builder()
    builder.feed(source or "")
    builder.close()
    root = builder.root
    page = next((n for n in root.children if n.tag == "html"), None)
    if page is None:
        page = Node("html")
        for child in root.children:
            page.append(child)
        root.children = []
        root.append(page)
    body = next((n for n in page.children if n.tag == "body"), None)
    if body is None:
        body = Node("body")
        rest = [c for c in page.children if c.tag != "head"]
        page.children = [c for c in page.children if c.tag == "head"]
        page.append(body)
        for child in rest:
            body.append(child)
    return root


def body_of(root: Node) -> Node:
    return root.find("body") or root


def serialize(node: Node) -> str:
    """Markup of the children of ``node``."""
    out: list[str] = []
    stack: list = list(reversed(node.children))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        elif item.tag is None:
            raw = item.parent is not None and item.parent.tag in RAW
            out.append(item.text if raw else html.escape(item.text, quote=False))
        else:
            attrs = "".join(f' {k}="{html.escape(v or "")}"' for k, v in item.attrs.items())
            out.append(f"<{item.tag}{attrs}>")
            if item.tag not in VOID:
                stack.append(f"</{item.tag}>")
                stack.extend(reversed(item.children))
    return "".join(out)
