"""Second cleaning of the chosen content: empty blocks, boilerplate blocks, link-dense blocks, tracking text, sign-up forms."""

from __future__ import annotations

import re

from pagewright.constants import BOILERPLATE
from pagewright.dom.content import squeezed
from pagewright.dom.tree import Node, body_of, parse, serialize

_PHRASES = [re.compile(rf"\b(?:{p})\b", re.I | re.A) for p in BOILERPLATE]
_ANY_PHRASE = re.compile(rf"\b(?:{'|'.join(BOILERPLATE)})\b", re.I | re.A)
_TRACKING = re.compile(r"([?&])(?:utm_[a-z_]+|fbclid|gclid|mc_cid|mc_eid)=[^\s&#]+", re.I)
_SIGN_UP = re.compile(r"\b(?:subscribe|sign\s*up|join)\b", re.I)
_SOLID = ("img", "br", "hr", "video", "audio", "iframe", "table", "pre", "code", "blockquote")


def phrase_count(text: str) -> int:
    return sum(bool(p.search(text)) for p in _PHRASES) if _ANY_PHRASE.search(text) else 0


def post_clean(markup: str) -> tuple[str, list[str]]:
    """Cleaned markup with white space collapsed, and the warnings of what was removed."""
    if not markup or not markup.strip():
        return "", []
    return post_clean_tree(body_of(parse(markup)))


def post_clean_tree(body: Node) -> tuple[str, list[str]]:
    """`post_clean` of the children of ``body``, which it changes."""
    warnings = []
    _drop_empty(body)
    if _drop(body, ("p", "li", "small", "div", "section"), _boilerplate_test()):
        warnings.append("BOILERPLATE_REMOVED")
    if _drop(body, ("p", "div", "section", "article", "li", "nav"), _is_link_dense):
        warnings.append("LINK_DENSE_BLOCKS_REMOVED")
    for node in list(body.walk()):
        if node.tag is None and "=" in node.text and _TRACKING.search(node.text):
            left = re.sub(r"[?&]$", "", _TRACKING.sub(r"\1", node.text))
            node.text = " ".join(left.split())
    _drop(body, ("form",), _is_sign_up)
    return " ".join(serialize(body).split()), warnings


def _drop(body: Node, tags: tuple, test) -> bool:
    """Remove the elements that pass ``test`` as they stand when reached, in document order; elements within removed ones are tested too."""
    hit = False
    for node in [n for n in body.elements() if n.tag in tags]:
        if test(node):
            node.remove()
            hit = True
    return hit


def _drop_empty(body: Node) -> None:
    """Remove blocks without text and solid elements, judged from the bottom up in one pass."""
    holds: set[int] = set()  # nodes that hold text or something solid
    for node in reversed(list(body.walk())):
        full = id(node) in holds or node.tag in _SOLID or node.tag is None and bool(node.text.strip())
        if full and node.parent is not None:
            holds.add(id(node.parent))
        elif not full and node is not body and node.tag in ("p", "div", "section", "article", "span", "li"):
            node.remove()


def _innermost(node: Node) -> Node:
    """The element within ``node`` that holds all of its text."""
    while True:
        inner = [c for c in node.children if c.tag or c.text.strip()]
        if len(inner) != 1 or inner[0].tag is None:
            return node
        node = inner[0]


def _boilerplate_test():
    known: dict[int, bool] = {}  # a chain of wrappers with the same text is read once

    def test(node: Node) -> bool:
        key = id(_innermost(node))
        if key not in known:
            text = squeezed(node)
            hits = phrase_count(text) if text else 0
            known[key] = hits >= 2 or hits == 1 and len(text) < 100
        return known[key]

    return test


def _within(node: Node, most: int) -> int:
    """Length of the squeezed text of ``node``, or ``most`` where it is at least that; stops reading there."""
    parts, size = [], 0
    for n in node.walk():
        if n.tag is None:
            parts.append(n.text)
            size += len("".join(n.text.split()))
            if size >= most:
                return most
    return min(most, len(" ".join("".join(parts).split())))


def _is_link_dense(node: Node) -> bool:
    total = _within(node, 200)
    return 0 < total < 200 and sum(len(squeezed(a)) for a in node.elements() if a.tag == "a") / total > 0.6


def _is_sign_up(form: Node) -> bool:
    parts = list(form.elements())
    mail = any(n.tag == "input" and n.get("type") == "email" for n in parts)
    said = " ".join(squeezed(n) or n.get("value") for n in parts if n.tag == "button" or n.tag == "input" and n.get("type") == "submit")
    return mail or bool(_SIGN_UP.search(said))
