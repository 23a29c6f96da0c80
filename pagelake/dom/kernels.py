"""Facts of a page, read off its tree in one parse. Decisions on them are made in DataFrame operators."""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlsplit

from ..schemas import EXCLUDE_SELECTORS
from . import content
from .markdown import html_to_markdown
from .parser import Node, body_of, parse
from .selectors import SelectorError, compile_selector, first, select

# What counts as a next link, a pagination region, a feed, a control, and hidden.
_PAGINATION = 'a[rel="next"], link[rel="next"]'
_REGION = '[class*="pagination" i], [class*="pager" i], nav[aria-label*="page" i]'
_FEED = '[class*="infinite" i], [data-infinite], [class*="feed" i], [aria-busy="true"]'
_CONTROLS = "button, a, [role='button'], input[type='button'], input[type='submit']"
_HIDDEN = "[hidden], [aria-hidden='true']"


def resolve(base: str | None, ref: str | None) -> str | None:
    """An absolute URL, or null if there is none. Scheme and host are lower-cased, default ports dropped, blanks encoded."""
    if ref is None:
        return None
    try:
        joined = urljoin(base or "", re.sub(r"[\t\n\r]", "", ref.strip()))
        parts = urlsplit(joined)
        if not parts.scheme:
            return None
        if parts.scheme not in ("http", "https"):
            return joined
        if not parts.hostname:
            return None
        port = f":{parts.port}" if parts.port and parts.port != {"http": 80, "https": 443}[parts.scheme] else ""
        safe = re.sub(r'[\s"<>`{}\\^]|[^\x00-\x7f]', lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), parts.path or "/")
        query = re.sub(r'[\s"<>]|[^\x00-\x7f]', lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), parts.query)
        return f"{parts.scheme}://{parts.hostname}{port}{safe}{'?' + query if query else ''}{'#' + parts.fragment if parts.fragment else ''}"
    except ValueError:
        return None


def loose(url: str | None) -> str | None:
    return re.sub(r"[?#].*", "", url, flags=re.S) if url is not None else None


def css_escape(value: str) -> str:
    return re.sub(r"([^a-zA-Z0-9_-])", r"\\\1", value)


def element_selector(node: Node) -> str:
    """tag#id, else tag[role], else tag with its first two usable classes, else tag."""
    if node.attrs.get("id"):
        return f"{node.tag}#{css_escape(node.attrs['id'])}"
    if node.attrs.get("role"):
        return f'{node.tag}[role="{css_escape(node.attrs["role"])}"]'
    names = [c for c in node.classes if len(c) <= 40 and not c[0].isdigit()][:2]
    return node.tag + "".join(f".{css_escape(c)}" for c in names)


def without(root: Node, selectors) -> list[str]:
    """Removes what the selectors match; gives the invalid ones."""
    bad = []
    for selector in selectors or ():
        try:
            for node in list(select(root, selector)):
                node.remove()
        except SelectorError:
            bad.append(selector)
    return bad


def visible(node: Node) -> bool:
    hidden = compile_selector(_HIDDEN)
    if any(hidden(a) for a in node.ancestors()):
        return False
    href = node.attrs.get("href", "")
    return bool(href.startswith("/") or re.match(r"https?://", href) or node.text().strip() or first(node, "img, picture, video"))


LINK = "STRUCT<node:INT, href:STRING, url:STRING, text:STRING, visible:BOOLEAN, path:ARRAY<STRUCT<id:INT, tag:STRING, selector:STRING>>>"
FACTS = f"links ARRAY<{LINK}>, controls ARRAY<STRUCT<node:INT, hrefs:ARRAY<STRING>>>, n_links INT, n_excluded INT, rel_next STRING, region STRING, feed BOOLEAN"


def listing_facts(html: str | None, url: str | None) -> dict:
    """Links, controls and pagination signals outside the excluded regions."""
    root = parse(html)
    total = sum(1 for _ in select(root, "a[href]"))
    without(root, EXCLUDE_SELECTORS)
    links = []
    for a in select(root, "a[href]"):
        path = [{"id": n.index, "tag": n.tag, "selector": element_selector(n)} for n in reversed(list(a.ancestors()))]
        links.append({"node": a.index, "href": a.attrs["href"], "url": resolve(url, a.attrs["href"]), "text": a.text().strip(), "visible": visible(a), "path": path})
    controls = []
    for node in select(root, _CONTROLS):
        if visible(node):
            controls.append({"node": node.index, "hrefs": [n.attrs["href"] for n in node.ancestors() if n.tag == "a" and "href" in n.attrs]})
    rel, region = first(root, _PAGINATION), first(root, _REGION)
    # A bare a[rel=next] has no telling selector; its relation is kept so that it can't match another link.
    rel_next = None if rel is None else 'link[rel="next"]' if rel.tag == "link" else element_selector(rel) if element_selector(rel) != "a" else 'a[rel="next"]'
    feed = first(root, _FEED) is not None or sum(1 for _ in select(root, "script")) >= 10
    return {"links": links, "controls": controls, "n_links": total, "n_excluded": total - len(links), "rel_next": rel_next, "region": None if region is None else element_selector(region), "feed": feed}


SPEC_FACTS = (
    "bad_excludes ARRAY<STRING>, bad_links BOOLEAN, container STRING, container_chars INT, hrefs ARRAY<STRUCT<url:STRING, text:STRING, fits:BOOLEAN>>, pattern_ok BOOLEAN, "
    "content STRING, content_chars INT, paging STRING, text_found BOOLEAN, next_rel STRING, next_selected STRING, html_length INT"
)


def _state(root: Node, selector: str | None) -> tuple[str | None, Node | None]:
    """none, invalid, missing or found, and what is found."""
    if not selector:
        return "none", None
    try:
        node = first(root, selector)
    except SelectorError:
        return "invalid", None
    return ("missing", None) if node is None else ("found", node)


def href_pattern(source: str | None) -> re.Pattern | None:
    """A pattern of the web's dialect, compiled; null if it is none. Named groups are written (?<name>...) there, and only there."""
    if source is None or "(?P" in source:
        return None
    try:
        return re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", source), re.ASCII)
    except (re.error, RecursionError, OverflowError):
        return None


def url_path(url: str | None) -> str:
    return urlsplit(url).path or "/" if url else ""


def spec_facts(html: str | None, url: str | None, spec: dict | None) -> dict:
    """What a spec's selectors find on a page. The next page is looked for on the whole page, the rest outside the excluded regions."""
    spec = spec or {}
    listing, article, paging = (spec.get(k) or {} for k in ("listing", "article", "pagination"))
    root = parse(html)
    relation = first(root, 'a[rel="next"]')
    next_state, next_node = _state(root, paging.get("selector"))
    to = lambda n: loose(resolve(url, n.attrs["href"])) if n is not None and n.attrs.get("href") else None
    next_rel, next_selected = to(relation), to(next_node)

    bad = without(root, listing.get("exclude_selectors"))
    container, scope = _state(root, listing.get("container_selector"))
    # The pattern is judged and applied here, by one engine.
    pattern = href_pattern(listing.get("article_link_href_pattern") or "")
    bad_links, hrefs = False, []
    try:
        for node in select(scope if scope is not None else root, listing.get("article_link_selector") or "["):
            target = resolve(url, node.attrs.get("href"))
            fits = target is not None and pattern is not None and pattern.search(url_path(target)) is not None
            hrefs.append({"url": target, "text": node.text().strip() or None, "fits": fits})
    except SelectorError:
        bad_links = True
    content_state, found = _state(root, article.get("content_selector"))
    state, _ = _state(root, paging.get("selector"))
    patterns = paging.get("text_patterns") or []
    text_found = bool(patterns) and any(p in n.text() for n in select(root, "button, a, [role='button']") for p in patterns)
    return {
        "bad_excludes": bad, "bad_links": bad_links, "container": container, "container_chars": len(scope.text().strip()) if scope is not None else None,
        "hrefs": hrefs, "pattern_ok": pattern is not None, "content": content_state, "content_chars": len(found.text().strip()) if found is not None else 0,
        "paging": state, "text_found": text_found, "next_rel": next_rel, "next_selected": next_selected, "html_length": len(html or ""),
    }


ARTICLE = "STRUCT<title:STRING, author:STRING, published_at:STRING, tags:ARRAY<STRING>, body_html:STRING, markdown:STRING, excerpt:STRING, error:STRING>"


def article(html: str | None, url: str | None, spec: dict | None = None, title_hint: str | None = None) -> dict:
    """Metadata, body and Markdown of an article page; error says why there is no body.

    The body is what the spec's selector finds, else the main content, else the first article, main or body with text."""
    spec_article = (spec or {}).get("article") or {}
    meta = spec_article.get("metadata_selectors") or {}
    root = parse(html)

    def text(selector: str | None) -> str | None:
        state, node = _state(root, selector)
        return node.text().strip() or None if state == "found" else None

    def attribute(selector: str) -> str | None:
        node = first(root, selector)
        return (node.attrs.get("content") or "").strip() or None if node is not None else None

    time = first(root, "time")
    date = text(meta.get("published_at"))
    if date is None and time is not None:
        date = (time.attrs.get("datetime") or "").split("T")[0] or time.text().strip() or None
    tags = None
    if meta.get("tags"):
        try:
            tags = [t for t in (n.text().strip() for n in select(root, meta["tags"])) if t] or None
        except SelectorError:
            tags = None
    title = text(meta.get("title")) or attribute('meta[property="og:title"]') or attribute('meta[name="twitter:title"]') or text("h1") or text("title") or title_hint or "Untitled"
    author, short = text(meta.get("author")), content.excerpt(root)
    body = ""
    if spec_article.get("method") == "selector":
        state, node = _state(root, spec_article.get("content_selector"))
        body = node.inner_html() if node is not None else ""
    if not body:
        plain = {name: node.inner_html() for name in ("article", "main") if (node := first(root, name)) is not None}
        whole = body_of(root)
        body = content.main_content(root) or plain.get("article") or plain.get("main") or (whole.inner_html() if whole.text().strip() else "")
    out = {"title": title, "author": author, "published_at": date, "tags": tags, "body_html": body, "markdown": None, "excerpt": short, "error": None}
    if not body.strip():
        return out | {"body_html": None, "error": f"nothing to extract at {url}"}
    return out | {"markdown": html_to_markdown(body)}


SNAPSHOT_NODE = "STRUCT<bfs_pos:INT, depth:INT, tag:STRING, elem_id:STRING, role:STRING, aria:STRING, classes:ARRAY<STRING>, href:STRING, text:STRING>"


def snapshot_nodes(html: str | None, most: int | None = 3000) -> list[dict]:
    """Elements of the body in breadth-first order, without invisible ones, scripts and anonymous wrappers; at most 3000, or as many as there are."""
    root = parse(html)
    without(root, ["script", "style", "svg", "noscript", "iframe", "meta", "link", "[hidden]", '[aria-hidden="true"]'])
    queue, out, at = [(body_of(root), 0)], [], 0
    while at < len(queue) and (most is None or len(out) < most):
        node, depth = queue[at]
        at += 1
        queue.extend((c, depth + 1) for c in node.elements)
        text = " ".join(" ".join(c.strip() for c in node.children if isinstance(c, str)).split())
        role, aria, classes = node.attrs.get("role") or None, node.attrs.get("aria-label") or None, node.classes[:3]
        if node.tag in ("div", "span") and not (node.attrs.get("id") or role or aria or classes or text):
            continue
        out.append({"bfs_pos": len(out), "depth": depth, "tag": node.tag, "elem_id": node.attrs.get("id") or None, "role": role, "aria": aria, "classes": classes or None, "href": node.attrs.get("href") or None if node.tag == "a" else None, "text": text or None})
    return out


def dom_nodes(html: str | None) -> list[dict]:
    """All elements, interval-encoded: descendants of a node are those with node_id in (node_id, end_id]."""
    root = parse(html)
    everything = [root, *root.descendants()]
    bfs, at = [root], 0
    while at < len(bfs):
        bfs.extend(bfs[at].elements)
        at += 1
    place = {n.index: i for i, n in enumerate(bfs)}
    rows = []
    for n in everything:
        direct = " ".join(" ".join(c.strip() for c in n.children if isinstance(c, str)).split())
        rows.append({"node_id": n.index, "end_id": n.end, "parent_id": n.parent.index if n.parent is not None else None, "depth": n.depth, "bfs_pos": place[n.index], "tag": n.tag, "attrs": n.attrs, "elem_id": n.attrs.get("id"), "classes": n.classes, "direct_text": direct, "text": n.text().strip()})
    return rows
