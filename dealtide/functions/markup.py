"""A small element tree and selector matcher for the page operators (runs inside tasks, one page at a time)."""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Element:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Element | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        element = Element(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(element)
        if tag not in VOID:
            self.here = element

    def handle_startendtag(self, tag, attrs):
        self.here.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.here))

    def handle_endtag(self, tag):
        at = self.here
        while at is not None and at.tag != tag:
            at = at.parent
        if at is not None and at.parent is not None:
            self.here = at.parent

    def handle_data(self, data):
        self.here.children.append(data)


def parse_html(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def text_of(element: Element) -> str:
    """All text below the element, in order."""
    parts, stack = [], [element]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            parts.append(node)
        else:
            stack.extend(reversed(node.children))
    return "".join(parts)


_ATTR = re.compile(r"\[([\w-]+)(?:([*^$~]?=)\"?([^\"\]]*)\"?)?\]")
_PART = re.compile(r":not\(([\w-]+)\)|\[[^\]]*\]|[.#]?[\w-]+|\*")


@lru_cache(maxsize=4096)
def _compile(selector: str) -> list[list[list]]:
    """Alternatives of descendant chains of simple tests."""
    alternatives = []
    for alternative in re.split(r",(?![^\[]*\])", selector):
        chain = []
        for compound in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", alternative.strip()):
            chain.append([_test(m.group(0), m.group(1)) for m in _PART.finditer(compound)])
        if chain:
            alternatives.append(chain)
    return alternatives


def _test(part: str, negated: str | None):
    if negated:
        return lambda e: e.tag != negated
    if part.startswith("["):
        name, how, value = _ATTR.match(part).groups()
        if how is None:
            return lambda e: name in e.attrs
        return {
            "=": lambda e: e.attrs.get(name) == value,
            "*=": lambda e: value in e.attrs.get(name, ""),
            "^=": lambda e: e.attrs.get(name, "").startswith(value),
            "$=": lambda e: e.attrs.get(name, "").endswith(value),
            "~=": lambda e: value in e.attrs.get(name, "").split(),
        }[how]
    if part.startswith("."):
        return lambda e: part[1:] in e.attrs.get("class", "").split()
    if part.startswith("#"):
        return lambda e: e.attrs.get("id") == part[1:]
    return (lambda e: True) if part == "*" else (lambda e: e.tag == part)


def _matches(element: Element, chain: list[list]) -> bool:
    if not all(test(element) for test in chain[-1]):
        return False
    above, rest = element.parent, chain[:-1]
    if not rest:
        return True
    while above is not None:
        if _matches(above, rest):
            return True
        above = above.parent
    return False


def select(root: Element, selector: str) -> list[Element]:
    """Elements below ``root`` that match, in document order."""
    found, stack = [], list(reversed(root.children))
    chains = _compile(selector)
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            continue
        if any(_matches(node, chain) for chain in chains):
            found.append(node)
        stack.extend(reversed(node.children))
    return found
