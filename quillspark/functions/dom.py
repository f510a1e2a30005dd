"""A small element tree for pages, built in one pass whose time grows with the page's length whatever the markup.

No step looks back or rescans: a tag that meets the next `<` before its end stops there, a quote that never closes is
looked for once, end tags consult a count of open elements, and walks keep their own stack instead of recursing. There
is no implied html or body, omitted end tags of paragraphs, items, cells and options are implied, and text of scripts
and styles is kept as it stands.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe".split())
SILENT = frozenset("script style template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements before which an open paragraph ends.
BLOCKS = HEADINGS | frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hr li main menu nav ol p pre section table ul".split())
#: What an element ends if it is open in the same list, table or choice, and the elements that begin such a scope.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol menu dl table select".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>\x00<]*")
_GAP = re.compile(r"[\s/]*")
#: A tag without attributes, and an attribute in double quotes: most of what occurs, read at once. Such a quote closes unless it is the last one.
_BARE = re.compile(r"<(/?)([a-zA-Z][^\s/>\x00<]*)>")
_QUOTED = re.compile(r"""([^\s=>/<"'][^\s=>/<]*)\s*=\s*"([^"]*)"[\s/]*""")
_ATTR = re.compile(r"([^\s=>/<\"'][^\s=>/<]*)(\s*=\s*)?")
_UNQUOTED = re.compile(r"[^\s><]*")
_SPACE = re.compile(r"\s+")


#: Where the text of each raw element ends.
_CLOSES = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


class Node:
    """An element: children are nodes and texts in order."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None) -> None:
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def get(self, name: str) -> str:
        return self.attrs.get(name) or ""

    @property
    def classes(self) -> list[str]:
        return self.get("class").split()

    @property
    def named(self) -> str:
        """Classes and id, for patterns on both."""
        return " ".join(self.classes) + " " + self.get("id")

    def append(self, child: Node | str) -> None:
        if isinstance(child, Node):
            child.parent = self
        self.children.append(child)

    def walk(self) -> Iterator[Node]:
        """This element and all below it, in the order of the page."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if node.children:
                stack += [c for c in node.children[::-1] if isinstance(c, Node)]

    def find(self, *tags: str) -> Node | None:
        """The first element below this one with one of the tags."""
        return next((n for n in self.walk() if n is not self and n.tag in tags), None)

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n is not self and n.tag in tags]

    def outermost(self, wanted: Callable[[Node], bool]) -> list[Node]:
        """Elements below this one for which wanted() holds, without those inside another: their contents do not overlap."""
        out, stack = [], [c for c in self.children[::-1] if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            if wanted(node):
                out.append(node)
            elif node.children:
                stack += [c for c in node.children[::-1] if isinstance(c, Node)]
        return out

    def texts(self) -> Iterator[str]:
        """Texts below in order; those of scripts and styles only of such an element itself."""
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            elif node.tag not in SILENT:
                stack.extend(reversed(node.children))

    def text(self, sep: str = " ") -> str:
        """All text below, pieces trimmed and joined."""
        return sep.join(t for t in (x.strip() for x in self.texts()) if t)

    def inner(self) -> str:
        return "".join(_written(self.children))

    def html(self) -> str:
        return "".join(_written([self]))


def _written(nodes: list[Node | str]) -> list[str]:
    """Pieces of markup; on the stack, an end tag stands as a tuple of its own."""
    out: list[str] = []
    stack: list[Node | str | tuple[str]] = nodes[::-1]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(html_lib.escape(node, quote=False))
        elif isinstance(node, tuple):
            out.append(node[0])
        else:
            tag = node.tag
            if node.attrs:
                out += ["<", tag, *[f' {k}="{html_lib.escape(v)}"' if v is not None else f" {k}" for k, v in node.attrs.items()], ">"]
            else:
                out.append(f"<{tag}>")
            if tag in RAW and tag != "title":
                out += [c for c in node.children if isinstance(c, str)]
                out.append(f"</{tag}>")
            elif tag not in VOID:
                stack.append((f"</{tag}>",))
                stack += node.children[::-1]
    return out


def first_below(nodes: list[Node], tag: str) -> dict[int, Node]:
    """By id of an element, the first one of a tag below it; the elements are given in the order of the page."""
    first: dict[int, Node] = {}
    for n in reversed(nodes):
        own = n if n.tag == tag else first.get(id(n))
        if own is not None and n.parent is not None:
            first[id(n.parent)] = own
    return first


def prune(root: Node, drop: Callable[[Node], bool]) -> None:
    """Take out every element below root for which drop() holds, with all below it."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.children:
            node.children = [c for c in node.children if isinstance(c, str) or not drop(c)]
            stack += [c for c in node.children if isinstance(c, Node)]


class _Builder:
    def __init__(self) -> None:
        self.root = Node("#root")
        # An open element, and what is open in the scope that it stands in: tag -> depths.
        self.open: list[tuple[Node, dict[str, list[int]]]] = [(self.root, {})]
        self.scope: dict[str, list[int]] = {}
        self.count: dict[str, int] = defaultdict(int)
        self.pieces: list[str] = []
        self.heading: int | None = None  # where the last heading was opened

    def _pop(self) -> None:
        node, scope = self.open.pop()
        self.count[node.tag] -= 1
        self.scope = scope
        if node.tag in scope:
            scope[node.tag].pop()

    def _cut(self, depth: int) -> None:
        while len(self.open) > depth:
            self._pop()

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if self.pieces:
            self.flush()
        if tag in BLOCKS and self.count["p"]:
            self.end("p")
        if tag in HEADINGS and self.heading is not None and self.heading < len(self.open) and self.open[self.heading][0].tag in HEADINGS:
            self._cut(self.heading)  # a heading that was never closed
        for other in ENDS.get(tag, ()):
            if self.scope.get(other):
                self._cut(self.scope[other][-1])
        above = self.open[-1][0]
        node = Node(tag, attrs, above)
        above.children.append(node)
        if tag in VOID:
            return
        self.open.append((node, self.scope))
        self.count[tag] += 1
        if tag in HEADINGS:
            self.heading = len(self.open) - 1
        if tag in ENDS:
            self.scope.setdefault(tag, []).append(len(self.open) - 1)
        if tag in SCOPES:
            self.scope = {}

    def end(self, tag: str) -> None:
        if self.pieces:
            self.flush()
        if not self.count[tag]:
            return
        while self.open[-1][0].tag != tag:
            self._pop()
        self._pop()

    def flush(self) -> None:
        """Pieces of text between two tags are one text."""
        if self.pieces:
            self.open[-1][0].children.append("".join(self.pieces))
            self.pieces = []


def parse(page: str | None) -> Node:
    """The tree of a page or fragment, under a root element of its own."""
    page = page or ""
    build, at, size = _Builder(), 0, len(page)
    absent: set[str] = set()  # what does not occur from here on

    def until(what: str, start: int) -> int:
        """Where `what` comes next, or -1; what was once not found is not looked for again."""
        if what in absent:
            return -1
        found = page.find(what, start)
        if found < 0:
            absent.add(what)
        return found

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            build.pieces.append(html_lib.unescape(page[at:]))
            break
        if lt > at:
            build.pieces.append(html_lib.unescape(page[at:lt]))
        bare = _BARE.match(page, lt)
        if bare and bare[1]:
            at = bare.end()
            build.end(bare[2].lower())
            continue
        nxt = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = until("-->", lt + 4)
            at = size if end < 0 else end + 3
        elif nxt in ("!", "?"):
            end = until(">", lt)
            at = size if end < 0 else end + 1
        elif nxt == "/":
            name = _NAME.match(page, lt + 2)
            end = until(">", lt)
            at = size if end < 0 else end + 1
            if name:
                build.end(name[0].lower())
        else:
            name = None if bare else _NAME.match(page, lt + 1)
            if bare:
                tag, at, attrs = bare[2].lower(), bare.end() - 1, {}
            elif name:
                tag, at, attrs = name[0].lower(), _GAP.match(page, name.end()).end(), {}
            else:
                build.pieces.append("<")
                at = lt + 1
                continue
            while at < size and page[at] not in "<>":
                m = _QUOTED.match(page, at)
                if m:
                    attrs.setdefault(m[1].lower(), html_lib.unescape(m[2]))
                    at = m.end()
                    continue
                m = _ATTR.match(page, at)
                if not m:  # a stray quote or sign
                    at = _GAP.match(page, at + 1).end()
                    continue
                at, value = m.end(), None
                if m[2]:
                    quote = page[at : at + 1]
                    end = until(quote, at + 1) if quote and quote in "\"'" else -1
                    if end >= 0:
                        value, at = page[at + 1 : end], end + 1
                    else:  # without quotes, or with one that never closes
                        value = _UNQUOTED.match(page, at)[0]
                        at += len(value)
                attrs.setdefault(m[1].lower(), None if value is None else html_lib.unescape(value))
                at = _GAP.match(page, at).end()
            at += page.startswith(">", at)
            build.start(tag, attrs)
            if tag in RAW:
                end = _CLOSES[tag].search(page, at)
                # Without an end tag the element takes the rest of the page.
                body = page[at : end.start() if end else size]
                if body:
                    build.pieces.append(html_lib.unescape(body) if tag in ("title", "textarea") else body)
                build.end(tag)
                close = page.find(">", end.end()) if end else -1
                at = size if close < 0 else close + 1
    build.flush()
    return build.root


def squeeze(text: str) -> str:
    return _SPACE.sub(" ", text).strip()
