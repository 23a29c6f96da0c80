"""The main content of an article page: the element in which prose is densest.

A block of text (an element without blocks of its own) weighs as much as its words, less twice those inside links; short
blocks weigh nothing. An element's score is the weight of the blocks in it, each level in between taking a fifth away, so
that a wrapper beats one of its sections, and the page beats neither. Regions that listing analysis leaves out, and what a
reader doesn't see, are taken out first."""

from __future__ import annotations

from .parser import Node, body_of, serialize
from .selectors import select

#: Elements that hold no prose, and words in class names or ids of regions that aren't the article.
_APART = frozenset("script style noscript template svg nav footer aside form button input select textarea iframe".split())
_REGIONS = ("nav", "menu", "sidebar", "footer", "breadcrumb", "related", "recommend", "share", "cookie", "advert", "banner", "comment")
_BLOCKS = frozenset("address article aside blockquote body dd div dl dt figure li main ol p pre section table tbody td tr ul".split())
SHORT, LINKED, LEVEL, MARKED = 6, 2.0, 0.8, 1.1


def _clean(root: Node) -> None:
    for node in list(root.descendants()):
        names = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower()
        hidden = "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true"
        if node.tag in _APART or hidden or node.tag not in ("article", "main", "body", "p") and any(word in names for word in _REGIONS):
            node.remove()


def _words(node: Node) -> int:
    return len(node.text().split())


def block_weight(node: Node) -> float:
    """What a block of text adds to the elements around it."""
    words = _words(node)
    return max(0.0, words - LINKED * sum(_words(a) for a in select(node, "a"))) if words >= SHORT else 0.0


def main_content(root: Node) -> str:
    """HTML of the content, or "" if no block is long enough. Changes the tree."""
    body = body_of(root)
    _clean(body)
    scores: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    for node in [body, *body.descendants()]:
        if node.tag not in _BLOCKS or any(c.tag in _BLOCKS for c in node.elements):
            continue
        share = block_weight(node)
        up = node.parent if node.parent is not None and node is not body else node
        while share > 0.01 and up is not None and up.tag != "html":
            nodes[id(up)] = up
            scores[id(up)] = scores.get(id(up), 0.0) + share
            share, up = share * LEVEL, up.parent
    if not scores:
        return ""
    best = nodes[max(scores, key=lambda k: (scores[k] * (MARKED if nodes[k].tag in ("article", "main") else 1), -nodes[k].depth))]
    return best.inner_html() if best is body else serialize(best)


def excerpt(html_root: Node) -> str:
    """The page's description, or its first paragraph."""
    for meta in select(html_root, 'meta[name="description"], meta[property="og:description"]'):
        if meta.attrs.get("content", "").strip():
            return meta.attrs["content"].strip()
    first = next((p for p in select(html_root, "p") if p.text().strip()), None)
    return " ".join(first.text().split()) if first else ""
