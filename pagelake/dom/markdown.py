"""Markdown from HTML: atx headings, fenced code, - bullets, tables, strikethrough and task lists.

Scripts, styles, navigation, footers and frames are dropped. Emphasis is _ and **, links are inline, and runs of blank
lines collapse; these are this module's own choices, in the common style."""

from __future__ import annotations

import re
import sys

from .parser import DEPTH, Node, body_of, parse

DROPPED = frozenset("script style nav footer iframe noscript template head".split())
_BLOCK = frozenset("address article aside blockquote body details div dl dt dd fieldset figure figcaption form h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section table ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ESCAPE = re.compile(r"([\\`*_\[\]])")
_BLANKS = re.compile(r"[ \t\r\n\f]+")
_OPENING = re.compile(r"^(\s*)(#{1,6} |[-+] |\d+\. |>)")
#: Text that stays as it is.
_PLAIN = re.compile(r"[A-Za-z0-9,]+(?: [A-Za-z0-9,]+)*")
_BROKEN = re.compile(r"\s*\n\s*")
_BEFORE_ITEM = re.compile(r"\n\n+(?=\s*(?:[-*]|\d+\.) )")
_TRAILING = re.compile(r"[ \t]+$", re.M)
_FENCED = re.compile(r"^(`{3,})[^\n`]*\n.*?\n\1$", re.S | re.M)
_LINE_END = re.compile(r"[ \t]+\n(?<!  \n)")
_BLANK_LINE = re.compile(r"\n[ \t]+(?=\n)")
_GAP = re.compile(r"\n{3,}")
_LINE_START = re.compile(r"(?m)^ (?=\S)")
_KEPT = re.compile(r"\x00(\d+)\x00")


def _wrapped(text: str, mark: str) -> str:
    core = text.strip()
    if not core:
        return text
    lead, tail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
    return f"{lead}{mark}{core}{mark}{tail}"


def _inline(node: Node) -> str:
    return "".join(_piece(c) for c in node.children)


def _piece(c: Node | str) -> str:
    if isinstance(c, str):
        if _PLAIN.fullmatch(c):
            return c
        return _OPENING.sub(r"\1\\\2", _ESCAPE.sub(r"\\\1", _BLANKS.sub(" ", c)))
    tag = c.tag
    if tag in DROPPED:
        return ""
    if tag in _BLOCK:
        return f"\n\n{_block(c)}\n\n"
    if tag == "br":
        return "  \n"
    if tag == "img":
        src = c.attrs.get("src", "")
        return f"![{c.attrs.get('alt', '')}]({src})\n\n" if src else ""
    if tag in ("em", "i"):
        return _wrapped(_inline(c), "_")
    if tag in ("strong", "b"):
        return _wrapped(_inline(c), "**")
    if tag in ("del", "s", "strike"):
        return _wrapped(_inline(c), "~~")
    if tag in ("code", "kbd", "samp", "tt"):
        text = re.sub(r"\s+", " ", c.text())
        fence = "`" * (max(map(len, re.findall(r"`+", text)), default=0) + 1)
        pad = " " if text.startswith("`") or text.endswith("`") else ""
        return f"{fence}{pad}{text}{pad}{fence}" if text else ""
    if tag == "a":
        text, href = _inline(c), c.attrs.get("href", "")
        title = c.attrs.get("title", "")
        if not href:
            return text
        return f"[{text.strip()}]({href}{f' {chr(34)}{title}{chr(34)}' if title else ''})" if text.strip() else ""
    if tag == "input" and c.attrs.get("type") == "checkbox":
        return "[x] " if "checked" in c.attrs else "[ ] "
    return _inline(c)


def _list(node: Node) -> str:
    ordered = node.tag == "ol"
    start = node.attrs.get("start", "1")
    at = int(start) if start.isdigit() else 1
    out = []
    for item in node.elements:
        if item.tag != "li":
            out.append(_block(item))
            continue
        mark = f"{at}. " if ordered else "- "
        at += 1
        loose = any(c.tag == "p" for c in item.elements)
        text = _tidy(_inline(item))
        if not loose:
            text = _BEFORE_ITEM.sub("\n", text)
        out.append(mark + text.replace("\n", "\n" + " " * len(mark)))
    return "\n".join(_TRAILING.sub("", x) for x in out)


def _table(node: Node) -> str:
    rows = [r for r in node.descendants() if r.tag == "tr"]
    grid = [[_line(_inline(c)).replace("|", "\\|") for c in r.elements if c.tag in ("td", "th")] for r in rows]
    grid = [r for r in grid if r]
    if not grid:
        return ""
    width = max(map(len, grid))
    grid = [r + [""] * (width - len(r)) for r in grid]
    heads = [c for c in rows[0].elements if c.tag in ("td", "th")]
    if not any(c.tag == "th" for c in heads):
        grid.insert(0, [""] * width)
        heads = []
    rule = []
    for i in range(width):
        align = heads[i].attrs.get("align", "").lower() if i < len(heads) else ""
        rule.append({"left": ":--", "right": "--:", "center": ":-:"}.get(align, "---"))
    return "\n".join("| " + " | ".join(r) + " |" for r in [grid[0], rule, *grid[1:]])


def _block(node: Node) -> str:
    tag = node.tag
    if tag in DROPPED:
        return ""
    if tag in _HEADINGS:
        text = _line(_inline(node))
        return f"{'#' * int(tag[1])} {text}" if text else ""
    if tag == "hr":
        return "* * *"
    if tag == "pre":
        code = node.elements[0] if len(node.elements) == 1 and node.elements[0].tag == "code" else node
        names = re.search(r"(?:language|lang)-(\S+)", code.attrs.get("class", ""))
        text = node.text().strip("\n")
        fence = "`" * max(3, max(map(len, re.findall(r"^`{3,}", text, re.M)), default=0) + 1)
        return f"{fence}{names[1] if names else ''}\n{text}\n{fence}"
    if tag == "blockquote":
        return "\n".join(f"> {line}".rstrip() for line in _tidy(_inline(node)).split("\n"))
    if tag in ("ul", "ol", "menu"):
        return _list(node)
    if tag == "table":
        return _table(node)
    return _inline(node)


def _line(text: str) -> str:
    """Tidied text in one line."""
    text = _tidy(text)
    return _BROKEN.sub(" ", text) if "\n" in text else text


def _tidy(text: str) -> str:
    if "\n" not in text and "\x00" not in text:
        return text.strip()
    fences: list[str] = []

    def keep(m: re.Match) -> str:
        fences.append(m[0])
        return f"\x00{len(fences) - 1}\x00"

    # Each pattern is tried only where it can fit.
    if "```" in text:
        text = _FENCED.sub(keep, text)
    if " \n" in text or "\t\n" in text:
        text = _LINE_END.sub("\n", text)
    if "\n " in text or "\n\t" in text:
        text = _BLANK_LINE.sub("\n", text)
    if "\n\n\n" in text:
        text = _GAP.sub("\n\n", text)
    if text.startswith(" ") or "\n " in text:
        text = _LINE_START.sub("", text)
    if "\x00" in text:
        text = _KEPT.sub(lambda m: fences[int(m[1])], text)
    return text.strip()


def html_to_markdown(html: str | None) -> str:
    # A level of the tree, of which the parser bounds the number, takes four calls.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * DEPTH))
    return _tidy(_inline(body_of(parse(html, numbered=False))))
