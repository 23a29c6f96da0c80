"""A tolerant HTML tree builder on the standard library's tokenizer.

It supplies html, head and body, ends elements that HTML ends implicitly, keeps script and style raw, and re-opens
formatting elements that were left open across blocks, as browsers do. It never fails on malformed input."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEAD = frozenset("title meta link base style script noscript template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start tag ends an open element of these, unless one of the others is in between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: Elements open at once; deeper ones become children of the last. Equal formatting elements, and all of them, that go on across blocks.
DEPTH, EQUAL, CARRIED = 400, 3, 24
SCOPE = frozenset("html body table td th caption button object template".split())
_P = frozenset({"p"})
_ENDS = {tag: (frozenset(ended), frozenset(stop | {"html", "body"})) for tag, (ended, stop) in ENDS.items()}
#: What an end tag doesn't reach across; formatting elements and p stay inside their cell, too.
_ROOTS = frozenset("html body head".split())
_CELLS = _ROOTS | {"table", "td", "th"}
#: Plain tags, which are read by one match; all others, and those of elements with text of their own kind, by the tokenizer.
_START = re.compile(r'<([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z][a-zA-Z0-9-]*="[^"]*")*)>')
_ATTRIBUTE = re.compile(r' ([a-zA-Z][a-zA-Z0-9-]*)="([^"]*)"')
_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
#: Text and the plain tag after it.
_STEP = re.compile(r'([^<]*)<(?:/([a-zA-Z][a-zA-Z0-9]*)|([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z][a-zA-Z0-9-]*="[^"]*")*))>')
_OWN_TEXT = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext svg math".split())


class Node:
    """An element. children: elements and strings in order; index: place in document order; end: the index of its last descendant."""

    __slots__ = ("tag", "attrs", "children", "parent", "index", "end", "depth")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []
        self.index = self.end = 0
        self.depth = 0 if parent is None else parent.depth + 1
        if parent is not None:
            parent.children.append(self)

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    @property
    def classes(self) -> list[str]:
        return list(dict.fromkeys(self.attrs.get("class", "").split()))

    def descendants(self) -> Iterator[Node]:
        """In document order, without the node itself."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def ancestors(self) -> Iterator[Node]:
        """From the node itself up."""
        node: Node | None = self
        while node is not None:
            yield node
            node = node.parent

    def text(self) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.children))
        return "".join(out)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def inner_html(self) -> str:
        return "".join(serialize(c) for c in self.children)


RAW = frozenset("script style xmp iframe noembed noframes plaintext".split())


def serialize(x: Node | str, raw: bool = False) -> str:
    if isinstance(x, str):
        return x if raw else x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    out: list[str] = []
    stack: list[tuple[Node | str, bool]] = [(x, False)]
    while stack:
        y, closing = stack.pop()
        if isinstance(y, str):
            out.append(y if closing else serialize(y))
        else:
            attrs = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in y.attrs.items())
            out.append(f"<{y.tag}{attrs}>")
            if y.tag not in VOID:
                stack.append((f"</{y.tag}>", True))
                keep = y.tag in RAW
                stack.extend((c, keep if isinstance(c, str) else False) for c in reversed(y.children))
    return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.html = Node("html")
        self.head = Node("head", parent=self.html)
        self.body: Node | None = None
        self.open: list[Node] = [self.html, self.head]
        self.formatting: list[Node] = []

    def _to_body(self) -> None:
        if self.body is None:
            self.body = Node("body", parent=self.html)
            self.open = [self.html, self.body]

    def _pop_to(self, node: Node) -> None:
        while self.open and self.open.pop() is not node:
            pass

    def _find(self, tags, stop) -> Node | None:
        for node in reversed(self.open):
            if node.tag in tags:
                return node
            if node.tag in stop:
                return None
        return None

    def updatepos(self, i: int, j: int) -> int:
        """Lines aren't counted."""
        return j

    def goahead(self, end: bool) -> None:
        """Plain tags at the head of what is left are read here, the rest from the first other markup on by the tokenizer."""
        raw, i = self.rawdata, 0
        while self.cdata_elem is None and (m := _STEP.match(raw, i)):
            text, ended, begun, attrs = m.groups()
            tag = (ended or begun).lower()
            if tag in _OWN_TEXT:
                break
            if text:
                self.handle_data(unescape(text))
            if ended:
                self.handle_endtag(tag)
            else:
                self.lasttag = tag
                self.handle_starttag(tag, [(k.lower(), unescape(v)) for k, v in _ATTRIBUTE.findall(attrs)] if attrs else [])
            i = m.end()
        self.rawdata = raw[i:]
        super().goahead(end)

    def parse_starttag(self, i: int) -> int:
        m = _START.match(self.rawdata, i)
        if m is None or (tag := m[1].lower()) in _OWN_TEXT:
            return super().parse_starttag(i)
        self.lasttag = tag
        self.handle_starttag(tag, [(k.lower(), unescape(v)) for k, v in _ATTRIBUTE.findall(m[2])] if m[2] else [])
        return m.end()

    def parse_endtag(self, i: int) -> int:
        m = _END.match(self.rawdata, i) if self.cdata_elem is None else None
        if m is None or (tag := m[1].lower()) in _OWN_TEXT:
            return super().parse_endtag(i)
        self.handle_endtag(tag)
        return m.end()

    def _reopen(self) -> None:
        """Formatting elements that a block's end closed go on in the next text."""
        if not self.formatting:
            return
        closed = [f for f in self.formatting if f not in self.open]
        for old in closed:
            if len(self.open) >= DEPTH:
                return
            new = Node(old.tag, dict(old.attrs), self.open[-1])
            self.open.append(new)
            self.formatting[self.formatting.index(old)] = new

    def handle_starttag(self, tag: str, attrs) -> None:
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v if v is not None else "")
        if tag == "html":
            self.html.attrs = own | self.html.attrs
            return
        if tag == "head":
            self.head.attrs = own | self.head.attrs
            return
        if tag == "body":
            self._to_body()
            self.body.attrs = own | self.body.attrs
            return
        if self.body is None:
            if tag not in HEAD:
                self._to_body()
        if tag in ENDS_P and (p := self._find(_P, SCOPE)):
            self._pop_to(p)
        if tag in ENDS:
            ended, stop = _ENDS[tag]
            while found := self._find(ended, stop):
                self._pop_to(found)
        if tag == "a" and (a := next((f for f in self.formatting if f.tag == "a"), None)):
            self.handle_endtag("a")
            if a in self.formatting:
                self.formatting.remove(a)
        if self.body is not None and tag not in ENDS_P and tag not in ENDS and tag not in HEAD:
            self._reopen()
        node = Node(tag, own, self.open[-1])
        if tag not in VOID and len(self.open) < DEPTH:
            self.open.append(node)
            if tag in FORMATTING:
                self._carry(node)

    def _carry(self, node: Node) -> None:
        equal = [f for f in self.formatting if f.tag == node.tag and f.attrs == node.attrs]
        for old in [*equal[: max(0, len(equal) - EQUAL + 1)], *self.formatting[: max(0, len(self.formatting) - CARRIED + 1)]]:
            if old in self.formatting:
                self.formatting.remove(old)
        self.formatting.append(node)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "head":
            self._to_body()
            return
        if tag == "br":
            self.handle_starttag("br", [])
            return
        node = self._find((tag,), _CELLS if tag in FORMATTING or tag == "p" else _ROOTS)
        if tag in FORMATTING:
            self.formatting = [f for f in self.formatting if f is not node] if node else self.formatting[:-1] if self.formatting and self.formatting[-1].tag == tag else self.formatting
        if node is None:
            if tag == "p" and self.body is not None:
                Node("p", parent=self.open[-1])
            return
        self._pop_to(node)
        if tag in ("td", "th", "table"):
            self.formatting = [f for f in self.formatting if f in self.open]

    def handle_data(self, data: str) -> None:
        if self.body is None and (self.open[-1] is self.head or self.open[-1] is self.html):
            if not data.strip():
                return
            self._to_body()
        if self.body is not None and self.open[-1].tag not in RAW and data.strip():
            self._reopen()
        top = self.open[-1]
        if top.children and isinstance(top.children[-1], str):
            top.children[-1] += data
        else:
            top.children.append(data)


def parse(html: str | None, numbered: bool = True) -> Node:
    """The html element of a page, its elements numbered in document order, unless their numbers aren't needed."""
    builder = _Builder()
    try:
        builder.feed(html or "")
        builder.close()
    except (AssertionError, ValueError, IndexError):
        pass  # what was read so far stands, as with any other malformed tail
    builder._to_body()
    if numbered:
        number(builder.html)
    return builder.html


def number(root: Node) -> None:
    index = 0
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, done = stack.pop()
        if done:
            node.end = index - 1
        else:
            node.index = index
            index += 1
            stack.append((node, True))
            stack.extend((c, False) for c in reversed(node.elements))


def body_of(root: Node) -> Node:
    return next(n for n in root.elements if n.tag == "body")
