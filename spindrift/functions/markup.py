"""Elements of a page by descendant steps, over balanced tags, in one pass over the page."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements that have no end tag, and those whose start ends an open paragraph.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
#: Elements whose start ends an open one of the same kind, up to the element that holds them.
_SIBLINGS = {"li": ("li", frozenset(("ul", "ol", "menu"))), "dt": ("dt", frozenset(("dl",))), "dd": ("dd", frozenset(("dl",))), "tr": ("tr", frozenset(("table",))), "td": ("td", frozenset(("tr", "table"))), "th": ("th", frozenset(("tr", "table"))), "option": ("option", frozenset(("select",)))}
_NO_SCOPE = frozenset(("button", "td", "th", "table", "caption", "object"))


@dataclass(frozen=True)
class Step:
    """An element of that name (any, if empty) with all of the classes and attribute values."""

    name: str = ""
    classes: tuple[str, ...] = ()
    attributes: tuple[tuple[str, str], ...] = ()

    def fits(self, name: str, attributes: dict[str, str]) -> bool:
        if self.name and self.name != name:
            return False
        if self.classes and not set(self.classes) <= set(attributes.get("class", "").split()):
            return False
        return all(attributes.get(n) == v for n, v in self.attributes)


def attributes_of(text: str) -> dict[str, str]:
    """The attributes of a tag, names in lower case, the first of a name; references decoded."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m.group(1).lower(), html.unescape(next((g for g in m.groups()[1:] if g is not None), "")))
    return out


@dataclass
class Found:
    """An element: its attributes, and its place among the page's texts and in the page."""

    attributes: dict[str, str]
    first: int
    begin: int
    last: int = 0
    end: int = 0


def select(page: str, paths: list[tuple[Step, ...]]) -> tuple[list[str], list[list[Found]]]:
    """The page's texts in order, and for each path its elements in order of their start.

    A path's last step is the element itself, each step before it one of its ancestors, in
    order. Elements without an end tag end with the element that holds them. Comments,
    scripts and styles are no text. Time is linear in the page.
    """
    texts: list[str] = []
    found: list[list[Found]] = [[] for _ in paths]
    stack: list[tuple[str, tuple[int, ...], list[Found]]] = []
    open_names: dict[str, int] = {}
    at = 0

    def close_to(size: int, end: int) -> None:
        while len(stack) > size:
            name, _, mine = stack.pop()
            open_names[name] -= 1
            for f in mine:
                f.last, f.end = len(texts), end

    def close_open(name: str, stop: frozenset[str], end: int) -> None:
        if open_names.get(name):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close_to(i, end)
                    return
                if stack[i][0] in stop:
                    return

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            texts.append(page[at : m.start()])
        at = m.end()
        name = (m.group(3) or "").lower()
        if not name:
            continue
        if m.group(2):
            close_open(name, frozenset(), m.start())
            continue
        if name in _BLOCK:
            close_open("p", _NO_SCOPE, m.start())
        if name in _SIBLINGS:
            close_open(*_SIBLINGS[name], m.start())
        attributes = attributes_of(m.group(4)) if m.group(4) else {}
        above = stack[-1][1] if stack else (0,) * len(paths)
        reached, mine = [], []
        for path, into, k in zip(paths, found, above, strict=True):
            if k >= len(path) - 1 and path[-1].fits(name, attributes):
                f = Found(attributes, len(texts), m.end(), len(texts), m.end())
                into.append(f)
                mine.append(f)
            reached.append(k + 1 if k < len(path) - 1 and path[k].fits(name, attributes) else k)
        if name not in _VOID and not (m.group(4) or "").endswith("/"):
            stack.append((name, tuple(reached), mine))
            open_names[name] = open_names.get(name, 0) + 1
    if at < len(page):
        texts.append(page[at:])
    close_to(0, len(page))
    return texts, found


def text_of(texts: list[str], f: Found) -> str:
    """An element's text: character references decoded, white space collapsed."""
    return " ".join(html.unescape("".join(texts[f.first : f.last])).split())
