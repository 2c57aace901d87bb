"""Document metadata: meta tags, JSON-LD and the document element, each field from its first source that has it."""

from __future__ import annotations

import json
import re

from pagewright.dom.tree import Node

FIELDS = ("title", "description", "author", "site_name", "published_date", "image_url", "canonical_url", "language")
_SPACE = re.compile(r"\s+")


def clean(value: object) -> str | None:
    """A string with white space collapsed, None for anything empty or no string."""
    if not isinstance(value, str):
        return None
    return _SPACE.sub(" ", value).strip() or None


def _first_of(value: object, *keys: str) -> str | None:
    """A string, the first useful element of an array, or the first useful key of an object."""
    if isinstance(value, list):
        return next((found for item in value if (found := _first_of(item, *keys))), None)
    if isinstance(value, dict):
        return next((found for key in keys if (found := clean(value.get(key)))), None)
    return clean(value)


def _linked_data(root: Node) -> dict[str, str | None]:
    """The first value of each field over all JSON-LD nodes, those of @graph before their holder. Malformed scripts are skipped."""
    found: dict[str, str | None] = {}
    for script in (n for n in root.elements() if n.tag == "script" and n.get("type") == "application/ld+json"):
        try:
            data = json.loads(script.text_content())
        except (ValueError, RecursionError):
            continue
        nodes = list(data) if isinstance(data, list) else [*(data["@graph"] if isinstance(data.get("@graph"), list) else []), data] if isinstance(data, dict) else []
        for node in (n for n in nodes if isinstance(n, dict)):
            publisher = node.get("publisher") if isinstance(node.get("publisher"), dict) else {}
            values = {
                "title": clean(node.get("headline")) or clean(node.get("name")),
                "description": clean(node.get("description")),
                "author": _first_of(node.get("author"), "name", "alternateName"),
                "site_name": clean(publisher.get("name")),
                "published_date": next((v for k in ("datePublished", "dateCreated", "uploadDate") if (v := clean(node.get(k)))), None),
                "image_url": _first_of(node.get("image"), "url", "contentUrl"),
            }
            for key, value in values.items():
                found[key] = found.get(key) or value
    return found


def metadata_of(root: Node) -> dict[str, str | None]:
    metas: dict[tuple[str, str], str | None] = {}
    title = canonical = language = None
    for node in root.elements():
        if node.tag == "meta":
            for kind in ("property", "name"):
                if node.get(kind):
                    metas.setdefault((kind, node.get(kind)), clean(node.get("content")))
        elif node.tag == "title" and title is None:
            title = node
        elif node.tag == "link" and canonical is None and node.get("rel") == "canonical":
            canonical = clean(node.get("href"))
        elif node.tag == "html" and language is None:
            language = clean(node.get("lang"))
    linked = _linked_data(root)

    def meta(*sources: tuple[str, str]) -> str | None:
        return next((v for s in sources if (v := metas.get(s))), None)

    return {
        "title": meta(("property", "og:title")) or linked.get("title") or (clean(title.text_content()) if title else None),
        "description": meta(("property", "og:description"), ("name", "description"), ("property", "description"), ("name", "twitter:description")) or linked.get("description"),
        "author": meta(("name", "author"), ("property", "author")) or linked.get("author"),
        "site_name": meta(("property", "og:site_name")) or linked.get("site_name"),
        "published_date": meta(("property", "article:published_time"), ("name", "article:published_time")) or linked.get("published_date"),
        "image_url": meta(("property", "og:image"), ("name", "twitter:image")) or linked.get("image_url"),
        "canonical_url": canonical,
        "language": language,
    }
