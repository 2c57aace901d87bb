"""Rows of a saved search results page: headed links with their address line, snippet and ad marks, and signs of a block page."""

from __future__ import annotations

import re

from pagewright.constants import AD_BADGES, BLOCKED_TEXT
from pagewright.dom.content import squeezed
from pagewright.dom.select import compile_selector
from pagewright.dom.tree import Node, body_of, parse

_AD_LABEL = compile_selector('[aria-label*="sponsored" i], [aria-label="ad" i], [aria-label="ads" i]')
_CHALLENGE = compile_selector('iframe[src*="recaptcha" i], script[src*="recaptcha" i]')
_CAPTCHA = compile_selector('input[name="captcha" i], form[action*="sorry" i]')
_NOT_PROSE = ("h3", "cite", "a", "script", "style", "noscript")


def _box(link: Node) -> Node:
    """The nearest enclosing card, else the parent."""
    return next((a for a in link.ancestors() if a.tag in ("article", "li", "div", "section")), link.parent or link)


def _texts(node: Node | None) -> list[str]:
    if node is None:
        return []
    inside = (n for n in node.elements() if n.tag in ("span", "div") and n.find(*_NOT_PROSE) is None)
    return [t for n in inside if len(t := squeezed(n)) >= 30]


def block_reason(root: Node, address: str | None) -> str | None:
    """Why a page is no results page, None if it is one."""
    if address and "/sorry/" in address.lower():
        return "Google returned a /sorry/ anti-bot page"
    nodes = list(root.elements())
    if any(_CHALLENGE(n) for n in nodes):
        return "Google reCAPTCHA challenge detected"
    if any(_CAPTCHA(n) for n in nodes):
        return "Google CAPTCHA form detected"
    said = squeezed(body_of(root)).lower()
    sign = next((s for s in BLOCKED_TEXT if s in said), None)
    return f"Google block/rate-limit signal detected: {sign}" if sign else None


def rows_of(source: str | None, address: str | None = None) -> tuple[str | None, list[dict]]:
    """(block reason, rows in document order): title, href as written, display_url, snippet, is_ad."""
    root = parse(source)
    rows = []
    for link in (n for n in root.elements() if n.tag == "a"):
        heading = link.find("h3")
        title = squeezed(heading) if heading is not None else ""
        if not title:
            continue
        box = _box(link)
        cite = box.find("cite") or (box.parent.find("cite") if box.parent is not None else None)
        beside = link.parent.next_element() if link.parent is not None else None
        texts = [*_texts(beside), *_texts(box.next_element()), *_texts(box)]
        badge = any(n.tag in ("span", "div", "label") and squeezed(n).lower() in AD_BADGES for n in box.elements())
        rows.append(
            {
                "title": title,
                "href": re.sub(r"\s+", "", link.get("href")),
                "display_url": (squeezed(cite) or None) if cite is not None else None,
                "snippet": next((t for t in texts if 40 <= len(t) <= 360), None),
                "is_ad": badge or any(_AD_LABEL(n) for n in box.elements()),
            }
        )
    return block_reason(root, address), rows
