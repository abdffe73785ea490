"""A small tree of tolerant HTML and of wiki storage markup, from the standard library's parser."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the key is closed by the start of one of the values.
CLOSES = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset({"li"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"}), "option": frozenset({"option"}),
}
SCOPES = {"li": frozenset({"ul", "ol"}), "td": frozenset({"table"}), "th": frozenset({"table"}), "tr": frozenset({"table"})}
SILENT = frozenset({"script", "style", "template", "head"})


class Node:
    __slots__ = ("tag", "attrs", "parts", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parts, self.parent = tag, attrs or {}, [], parent

    @property
    def children(self) -> list[Node]:
        return [x for x in self.parts if isinstance(x, Node)]

    def raw_text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.parts))
        return "".join(out)

    def text(self) -> str:
        return " ".join(self.raw_text().split())

    def get(self, name: str) -> str | None:
        return self.attrs.get(name, self.attrs.get(name.lower()))

    def walk(self):
        """Descendants, parents before children."""
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            yield x
            stack.extend(reversed(x.children))

    def find_all(self, name: str) -> list[Node]:
        return [x for x in self.walk() if x.is_(name)]

    def is_(self, name: str) -> bool:
        """By the full name if one with a prefix is asked for, else by the name behind any prefix."""
        return self.tag == name if ":" in name else self.tag.rpartition(":")[2] == name

    def child(self, name: str) -> Node | None:
        return next((x for x in self.children if x.is_(name)), None)

    def children_of(self, name: str) -> list[Node]:
        return [x for x in self.children if x.is_(name)]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("#root")

    def _up_to(self, tag: str, scope: frozenset[str]) -> None:
        x = self.now
        while x.parent is not None and x.tag not in scope:
            if x.tag == tag:
                self.now = x.parent
                return
            x = x.parent

    def handle_starttag(self, tag: str, attrs) -> None:
        for open_, by in CLOSES.items():
            if tag in by:
                self._up_to(open_, SCOPES.get(open_, frozenset({"td", "th", "li", "blockquote", "div"})))
        node = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.parts.append(node)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag: str, attrs) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.parts.append(node)

    def handle_endtag(self, tag: str) -> None:
        x = self.now
        while x.parent is not None:
            if x.tag == tag:
                self.now = x.parent
                return
            x = x.parent

    def handle_data(self, data: str) -> None:
        self.now.parts.append(data)


def parse(markup: str | None) -> Node:
    """The tree of a fragment. CDATA sections become text first; anything malformed is taken as far as it goes."""
    text = re.sub(r"<!\[CDATA\[(.*?)\]\]>", lambda m: escape(m[1], quote=False), markup or "", flags=re.S)
    builder = _Builder()
    builder.feed(text)
    builder.close()
    return builder.root
