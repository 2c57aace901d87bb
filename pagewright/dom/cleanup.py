"""Removal of page noise before the main content is chosen. Content worth keeping makes its ancestors immune."""

from __future__ import annotations

import re

from pagewright.constants import PRESERVED_SELECTORS, REMOVED_SELECTORS, REMOVED_TOKENS
from pagewright.dom.select import Selectors
from pagewright.dom.tree import Node

#: Elements that browsers never show. There is no style engine here: hiding is read from inline style and attributes.
UNSHOWN = frozenset(("head", "title", "meta", "link", "script", "style", "template", "noscript", "base"))
_TOKENS = re.compile("|".join(map(re.escape, REMOVED_TOKENS)))
_PRESERVED, _REMOVED = Selectors(PRESERVED_SELECTORS), Selectors(REMOVED_SELECTORS)
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _immune(root: Node) -> set[int]:
    """Ids of nodes that match a preserved selector and of all their ancestors."""
    marked: set[int] = set()
    for node in root.elements():
        if _PRESERVED.match(node):
            marked.add(id(node))
            for above in node.ancestors():
                if id(above) in marked:
                    break  # its ancestors are marked already
                marked.add(id(above))
    return marked


def _hidden(node: Node) -> bool:
    if node.tag in UNSHOWN:
        return True
    return bool(node.attrs) and ("hidden" in node.attrs or node.get("aria-hidden").lower() == "true" or bool(_HIDDEN_STYLE.search(node.get("style"))))


def clean_tree(root: Node) -> None:
    """Remove noise from ``root`` in place.

    Each element is judged once from the top down; what stands below a removed element goes
    with it. An element is removed for a removed selector, a noise token in class or id, or
    being hidden. Lazy images get their source, loose vector images go, and empty
    containers are pruned from the bottom up, so that their parents can follow.
    """
    immune = _immune(root)
    stack = [root]
    while stack:
        node = stack.pop()
        kept = []
        for child in node.children:
            if child.tag and id(child) not in immune:
                if _REMOVED.match(child) or child.attrs and _TOKENS.search(f"{child.get('class')} {child.get('id')}".lower()) or _hidden(child):
                    child.parent = None
                    continue
                if child.tag == "svg" and child.get("role").lower() != "img" and not any(a.tag == "figure" for a in child.ancestors()):
                    child.parent = None
                    continue
            kept.append(child)
        node.children = kept
        stack.extend(c for c in kept if c.tag)
    for node in list(root.elements()):
        if node.tag == "img" and not node.get("src"):
            lazy = node.get("data-src") or node.get("data-lazy-src")
            if lazy:
                node.attrs["src"] = lazy
    _prune(root, immune)


def _prune(root: Node, immune: set[int]) -> None:
    for node in reversed(list(root.elements())):
        if node.tag in ("div", "section", "span") and id(node) not in immune:
            if not any(c.tag for c in node.children) and not node.text_content().strip():
                node.remove()
