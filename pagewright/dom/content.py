"""Choice of a page's main content by text and link density (own design, after published block-scoring ideas).

Semantic containers come first; otherwise each container gets the points of its paragraphs
(length and commas), half of which count for its own parent, reduced by its link density.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pagewright.dom.tree import Node, body_of

_BYLINE = re.compile(r"(?:^|[\s_-])(?:byline|author|writtenby|p-author)(?:$|[\s_-])", re.I)
_PARAGRAPHS = ("p", "pre", "td", "blockquote", "li", "dd")
#: Text of a semantic container from which it is taken without scoring, and of a page that reads as an article.
ENOUGH, READABLE = 140, 500


@dataclass
class Article:
    title: str
    byline: str | None
    excerpt: str | None
    node: Node
    lang: str | None


def squeezed(node: Node) -> str:
    return " ".join(node.text_content().split())


def link_share(node: Node) -> float:
    total = len(squeezed(node))
    return sum(len(squeezed(a)) for a in node.elements() if a.tag == "a") / total if total else 0.0


def _semantic(root: Node) -> Node | None:
    best, size = None, 0
    for node in root.elements():
        if node.tag in ("article", "main") or node.get("role") == "main" or node.get("itemprop") == "articleBody":
            length = len(squeezed(node))
            if length > size and (best is None or length > 1.2 * size):
                best, size = node, length
    return best if size >= ENOUGH and link_share(best) < 0.6 else None


def _scored(root: Node) -> Node | None:
    points: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    for node in root.elements():
        if node.tag not in _PARAGRAPHS:
            continue
        text = squeezed(node)
        if len(text) < 25:
            continue
        worth = 1 + text.count(",") + min(3, len(text) // 100)
        for share, holder in zip((1.0, 0.5), node.ancestors()):
            if holder.tag in (None, "#document", "html"):
                break
            points[id(holder)] = points.get(id(holder), 0.0) + share * worth
            nodes[id(holder)] = holder
    best = max(points, key=lambda k: points[k] * (1 - link_share(nodes[k])), default=None)
    return nodes[best] if best is not None else None


def is_readable(root: Node) -> bool:
    """Whether the paragraphs of 140 characters or more hold enough text for an article."""
    return sum(n for p in root.elements() if p.tag in ("p", "pre", "blockquote") and (n := len(squeezed(p))) >= ENOUGH) >= READABLE


def article_of(root: Node, title: str | None, language: str | None) -> Article | None:
    """The main content of a cleaned page, None where nothing holds text."""
    body = body_of(root)
    chosen = _semantic(root) or _scored(root) or (body if squeezed(body) else None)
    if chosen is None:
        return None
    byline = None
    for node in root.elements():
        if node.get("rel") == "author" or node.get("itemprop") == "author" or _BYLINE.search(f"{node.get('class')} {node.get('id')}"):
            words = squeezed(node)
            if 0 < len(words) < 100:
                byline = words
                break
    excerpt = next((t for p in chosen.elements() if p.tag == "p" and (t := squeezed(p))), None)
    heading = root.find("h1")
    name = title or (squeezed(heading) if heading else "")
    return Article(name or "", byline, excerpt, chosen, language)
