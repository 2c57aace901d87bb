"""Rendering of cleaned markup as plain text, markdown or sanitised markup, with the text normalisation they share."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pagewright.constants import KEPT_ATTRIBUTES, PASS_THROUGH, TEXT_BLOCKS
from pagewright.dom.tree import Node, body_of, parse, serialize

_SPACE = re.compile(r"\s+")
_BLOCKS, _THROUGH = frozenset(TEXT_BLOCKS), frozenset(PASS_THROUGH)
_DEEP = frozenset(("table", "blockquote", "ul", "ol", "pre"))
_MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*"}


def truncate_words(text: str, limit: int) -> str:
    """At most ``limit`` characters, cut at a word's end; '' where the first word is longer."""
    if limit <= 0:
        return ""
    if len(text) <= limit:
        return text
    chunk = text[:limit]
    if text[limit].isspace():
        return chunk.rstrip()
    cut = max(chunk.rfind(c) for c in " \n\r\t")
    return chunk[:cut].rstrip() if cut > 0 else ""


def normalize(text: str, limit: int | None = None) -> str:
    """NFKC, horizontal white space collapsed, at most one empty line in a row, each line trimmed."""
    flat = re.sub(r"[^\S\n]+", " ", unicodedata.normalize("NFKC", text))
    out = "\n".join(line.strip() for line in re.sub(r"\n{3,}", "\n\n", flat).split("\n")).strip()
    return out if limit is None else truncate_words(out, limit)


def plain_text(body: Node) -> str:
    """Text with blocks set apart by empty lines and breaks as line breaks."""
    parts: list[str] = []
    stack: list = [body]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            parts.append(item)
        elif item.tag is None:
            parts.append(_SPACE.sub(" ", item.text))
        elif item.tag == "br":
            parts.append("\n")
        elif item.tag == "hr":
            parts.append("\n\n")
        else:
            block = item.tag in _BLOCKS
            if block:
                parts.append("\n\n")
                stack.append("\n\n")
            stack.extend(reversed(item.children))
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", "".join(parts))).strip()
    return text.replace("\n ", "\n").replace(" \n", "\n")


def _literal(text: str) -> str:
    return re.sub(r"(^|\n)#", r"\1\\#", re.sub(r"([*\[\]`])", r"\\\1", text))


class Markdown:
    """Renders a tree as markdown. Lists below the second level and blocks below the second are flattened to their text."""

    def render(self, body: Node) -> str:
        return re.sub(r"<[^>]+>", "", self.blocks(body, 0, 0))

    def flat(self, node: Node) -> str:
        return _literal(node.text_content())

    def leaf(self, node: Node) -> str:
        """What holds no other marks."""
        if node.tag is None:
            return _literal(node.text)
        if node.tag == "code":
            return f"`{self.flat(node)}`"
        if node.tag == "img" and "src" in node.attrs:
            return f"![{_literal(node.get('alt'))}]({node.get('src')})"
        return "\n" if node.tag == "br" else self.flat(node)

    def inline(self, node: Node) -> str:
        """A node with its marks; marks within marks at any depth, without recursion."""
        frames: list[tuple[Node | None, Iterator[Node], list[str]]] = [(None, iter((node,)), [])]
        while True:
            holder, rest, parts = frames[-1]
            child = next(rest, None)
            if child is not None:
                if child.tag in _MARKS or child.tag == "a" and "href" in child.attrs:
                    frames.append((child, iter(child.children), []))
                else:
                    parts.append(self.leaf(child))
                continue
            said = "".join(parts)
            if holder is None:
                return said
            frames.pop()
            mark = _MARKS.get(holder.tag)
            frames[-1][2].append(f"{mark}{said}{mark}" if mark else f"[{said.strip() or self.flat(holder)}]({holder.get('href')})")

    def inlines(self, node: Node) -> str:
        return "".join([self.inline(c) for c in node.children])

    def blocks(self, node: Node, lists: int, depth: int) -> str:
        """The blocks below a node, through containers at any depth; quotes and lists nest twice at most."""
        out, stack = [], list(reversed(node.children))
        while stack:
            child = stack.pop()
            if child.tag in _THROUGH:
                stack.extend(reversed(child.children))
            else:
                out.append(self.block(child, lists, depth))
        return "".join(out)

    def block(self, node: Node, lists: int, depth: int) -> str:
        tag = node.tag
        if tag is None:
            return _literal(node.text)
        if depth >= 2 and tag in _DEEP:
            return self.flat(node) + "\n\n"
        if re.fullmatch("h[1-6]", tag):
            return f"\n\n{'#' * int(tag[1])} {self.inlines(node).strip()}\n\n"
        if tag == "p":
            return f"\n\n{self.inlines(node).strip()}\n\n"
        if tag == "pre":
            return self.fence(node)
        if tag in ("ul", "ol"):
            return self.list(node, lists, depth)
        if tag == "blockquote":
            inner = self.blocks(node, lists, depth + 1).strip()
            return "\n\n" + "\n".join(f"> {line}" if line else ">" for line in inner.split("\n")) + "\n\n" if inner else ""
        if tag == "table":
            return self.table(node)
        if tag == "hr":
            return "\n\n---\n\n"
        if tag == "img":
            return self.inline(node) + "\n\n"
        return self.inline(node)

    def fence(self, node: Node) -> str:
        first = next((c for c in node.children if c.tag), None)
        code = first if first is not None and first.tag == "code" else node
        lang = re.search(r"(?:language|lang)-([A-Za-z0-9_-]+)", code.get("class")) if code is first else None
        return f"\n\n```{lang.group(1) if lang else ''}\n{code.text_content().strip(chr(10))}\n```\n\n"

    def list(self, node: Node, lists: int, depth: int) -> str:
        if lists >= 2:
            return self.flat(node) + "\n\n"
        ordered = node.tag == "ol"
        indent = ("   " if ordered else "  ") * lists
        lines = []
        for number, item in enumerate((c for c in node.children if c.tag == "li"), 1):
            own = "".join(self.inline(c) for c in item.children if c.tag not in ("ul", "ol")).strip()
            lines.append(f"{indent}{f'{number}.' if ordered else '-'} {own}".rstrip())
            below = "".join(self.block(c, lists + 1, depth + 1) for c in item.children if c.tag in ("ul", "ol")).strip()
            if below:
                lines.append(below)
        return "\n".join(lines) + "\n\n"

    def table(self, node: Node) -> str:
        rows = [[self.inlines(c).replace("|", "\\|").strip() or " " for c in r.children if c.tag in ("td", "th")] for r in node.elements() if r.tag == "tr"]
        rows = [r for r in rows if r]
        if not rows:
            return ""
        width = max(map(len, rows))
        head, *rest = ["| " + " | ".join(r + [" "] * (width - len(r))) + " |" for r in rows]
        return "\n\n" + "\n".join([head, "| " + " | ".join(["---"] * width) + " |", *rest]) + "\n\n"


def markdown(body: Node, limit: int) -> str:
    return truncate_words(normalize(Markdown().render(body)), limit)


def sanitized(body: Node, limit: int) -> str:
    """Markup with only the kept attributes, cut after a whole tag where it is too long (open elements are closed again)."""
    for node in body.elements():
        node.attrs = {k: v for k, v in node.attrs.items() if k in KEPT_ATTRIBUTES}
    out = serialize(body).strip()
    if limit <= 0:
        return ""
    if len(out) <= limit:
        return out
    cut = out.rfind(">", 0, limit)
    if cut > 0:
        return serialize(body_of(parse(out[: cut + 1].rstrip()))).rstrip()
    cut = out.rfind(" ", 0, limit)
    return out[: cut if cut > 0 else limit].rstrip()


def render_tree(body: Node, output_format: str, limit: int) -> tuple[str, str]:
    """(content in the wanted format, plain text), both within ``limit`` characters. The html format changes ``body``."""
    text = normalize(plain_text(body), limit)
    if output_format == "markdown":
        return markdown(body, limit), text
    return (sanitized(body, limit), text) if output_format == "html" else (text, text)


def tree_link_density(body: Node) -> float:
    """Characters in links over all characters, at most 1; 0 without text."""
    total = len(" ".join(body.text_content().split()))
    linked = sum(len(" ".join(a.text_content().split())) for a in body.elements() if a.tag == "a")
    return min(1.0, linked / total) if total else 0.0


def render(markup: str, output_format: str, limit: int) -> tuple[str, str]:
    """`render_tree` of markup; '' for none."""
    return render_tree(body_of(parse(markup)), output_format, limit) if markup and markup.strip() else ("", "")


def link_density(markup: str | None) -> float:
    return tree_link_density(body_of(parse(markup))) if markup and markup.strip() else 0.0
