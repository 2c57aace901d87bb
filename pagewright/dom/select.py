"""A small selector language: type, #id, .class, attribute tests with the i flag, descendant pairs inside :not, and lists."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pagewright.dom.tree import Node

Test = Callable[[Node], bool]
_PART = re.compile(
    r"""(?P<type>[a-zA-Z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)
    |\[(?P<attr>[\w-]+)(?:(?P<op>[*^$]?=)(?P<q>["'])(?P<val>.*?)(?P=q)\s*(?P<flag>i)?)?\]
    |:not\((?P<neg>(?:\[[^\]]*\]|[^()\[\]])*)\)""",
    re.X,
)


def _attribute(name: str, op: str | None, value: str | None, fold: bool) -> Test:
    if op is None:
        return lambda n: name in n.attrs
    wanted = value.lower() if fold else value
    compare = {"=": str.__eq__, "*=": lambda a, b: b in a, "^=": str.startswith, "$=": str.endswith}[op]
    if fold:
        return lambda n: name in n.attrs and compare(n.get(name).lower(), wanted)
    return lambda n: name in n.attrs and compare(n.get(name), wanted)


def _compound(text: str) -> Test:
    tests: list[Test] = []
    at = 0
    while at < len(text):
        hit = _PART.match(text, at)
        if not hit:
            raise ValueError(f"selector not understood: {text!r}")
        at = hit.end()
        if hit["type"]:
            tests.append(lambda n, t=hit["type"].lower(): n.tag == t)
        elif hit["id"]:
            tests.append(lambda n, t=hit["id"]: n.get("id") == t)
        elif hit["cls"]:
            tests.append(lambda n, t=hit["cls"]: t in n.get("class").split())
        elif hit["attr"]:
            tests.append(_attribute(hit["attr"], hit["op"], hit["val"], bool(hit["flag"])))
        else:
            inner = compile_selector(hit["neg"].strip())
            tests.append(lambda n, t=inner: not t(n))
    return tests[0] if len(tests) == 1 else lambda n: all(t(n) for t in tests)


def _split(text: str, sign: str) -> list[str]:
    """Parts at ``sign`` outside of brackets."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(text):
        depth += (c in "[(") - (c in "])")
        if c == sign and not depth:
            out.append(text[start:k])
            start = k + 1
    return [p.strip() for p in [*out, text[start:]] if p.strip()]


@lru_cache(maxsize=512)
def compile_selector(selector: str) -> Test:
    """Whether a node matches ``selector``."""
    choices = []
    for choice in _split(selector, ","):
        *outer, last = (_compound(p) for p in _split(choice, " "))

        def test(node: Node, outer=tuple(reversed(outer)), last=last) -> bool:
            if not last(node):
                return False
            above = node.ancestors()
            return all(any(o(a) for a in above) for o in outer)

        choices.append(test if outer else last)
    return choices[0] if len(choices) == 1 else lambda n: any(c(n) for c in choices)


class Selectors:
    """Many selectors as one test. A selector that names no type needs an attribute, so plain elements skip those."""

    def __init__(self, selectors):
        self.by_tag: dict[str, list[Test]] = {}
        self.by_attribute: list[Test] = []
        for selector in selectors:
            first = re.match(r"[a-zA-Z][\w-]*", _split(_split(selector, ",")[0], " ")[-1])
            if first and len(_split(selector, ",")) == 1:
                self.by_tag.setdefault(first.group().lower(), []).append(compile_selector(selector))
            else:
                self.by_attribute.append(compile_selector(selector))

    def match(self, node: Node) -> bool:
        own = self.by_tag.get(node.tag)
        if own and any(t(node) for t in own):
            return True
        return bool(node.attrs) and any(t(node) for t in self.by_attribute)


def select(root: Node, selector: str) -> list[Node]:
    test = compile_selector(selector)
    return [n for n in root.elements() if test(n)]


def select_one(root: Node, selector: str) -> Node | None:
    test = compile_selector(selector)
    return next((n for n in root.elements() if test(n)), None)
