"""Pages that a browser renders: collection and validation through sessions that the caller provides.

The engine holds no browser. `open_session(url)` is called on the executors and gives a Session: an object that has loaded
the page, answers questions about its present state and acts on it. A session has state, so a listing's walk is one loop in
one task; its steps have the form of those of `collect.walk`, and the same window functions settle where it ends. Listings
are dealt over tasks by their id, without HTML, since the session loads the page itself. A walk whose executor is lost
begins anew with a new session; a session that fails ends its own walk alone."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from typing import Protocol
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame

from .. import schemas
from ..dom import kernels
from ..sources.pages import per_page


class Session(Protocol):
    """A rendered page. `click_candidate` and `navigate` may be absent, and `close` too."""

    def count(self, selector: str) -> int: ...
    def texts(self, selector: str) -> list[str]: ...
    def hrefs(self, selector: str) -> list[str]: ...
    def click(self, selector: str) -> bool: ...
    def click_text(self, patterns: Sequence[str]) -> bool: ...
    def click_candidate(self, link_selector: str) -> bool: ...
    def scroll(self) -> None: ...
    def navigate(self, url: str) -> bool: ...
    def wait(self, milliseconds: int) -> None: ...
    def html(self) -> str: ...
    def url(self) -> str: ...


Opener = Callable[[str], Session]


@contextmanager
def _opened(open_session: Opener, url: str) -> Iterator[Session]:
    session = open_session(url)
    try:
        yield session
    finally:
        close = getattr(session, "close", None)
        if close is not None:
            close()


def link_selector(spec: dict) -> str:
    """The spec's links within its container. Excluded regions aren't removed from a live page."""
    listing = spec["listing"]
    return " ".join(s for s in (listing.get("container_selector"), listing["article_link_selector"]) if s)


def _quiet(ask: Callable[[str], list[str]], selector: str) -> list[str]:
    try:
        return list(ask(selector))
    except Exception:  # noqa: BLE001  what can't be told is taken as nothing
        return []


def _links(session: Session, url: str, spec: dict, hrefs: list[str]) -> list[dict]:
    """Links as spec_facts gives them: url, text, fits."""
    pattern = kernels.href_pattern(spec["listing"].get("article_link_href_pattern") or "")
    texts = _quiet(session.texts, link_selector(spec))
    out = []
    for i, href in enumerate(hrefs):
        target = kernels.resolve(url, href)
        fits = target is not None and pattern is not None and pattern.search(kernels.url_path(target)) is not None
        out.append({"url": target, "text": (texts[i].strip() or None) if i < len(texts) else None, "fits": fits})
    return out


def next_from_template(template: str, current: str) -> str | None:
    """The template with the number after that of the current URL's page (or p); 2 if it has none."""
    query = dict(reversed(parse_qsl(urlsplit(current).query, keep_blank_values=True)))
    told = query.get("page", query.get("p")) or "1"
    return kernels.resolve(current, template.replace("{n}", str(int(told) + 1 if told.isdecimal() else 2)))


def _scroll(session: Session, pause: int) -> None:
    session.scroll()
    session.wait(pause)


def _by_scroll(session: Session, spec: dict, url: str, pause: int) -> bool:
    _scroll(session, pause)
    return True


def _by_button(session: Session, spec: dict, url: str, pause: int) -> bool:
    """A control by its text, else by its selector; the page is scrolled whether or not there is one."""
    paging = spec["pagination"]
    texts, selector = paging.get("text_patterns"), paging.get("selector")
    if (texts and session.click_text(texts)) or (selector and session.click(selector)):
        session.wait(pause)
    _scroll(session, pause)
    return True


def _by_whatever_works(session: Session, spec: dict, url: str, pause: int) -> bool:
    """Scrolling; if that brings no link, the control that the session takes for pagination."""
    selector = link_selector(spec)
    before = _quiet(session.hrefs, selector)
    _scroll(session, pause)
    after = _quiet(session.hrefs, selector)
    moved = len(after) > len(before) or not set(after) <= set(before)
    click = getattr(session, "click_candidate", None)
    if not moved and click is not None and click(selector):
        session.wait(pause)
    return True


def _by_url(session: Session, spec: dict, url: str, pause: int) -> bool:
    paging = spec["pagination"]
    if paging.get("url_template"):
        target = next_from_template(paging["url_template"], url)
    else:
        found = session.hrefs(paging["selector"]) if paging.get("selector") else []
        target = kernels.loose(kernels.resolve(url, found[0])) if found else None
    go = getattr(session, "navigate", None)
    if target is None or target == url or go is None or not go(target):
        return False
    session.wait(pause)
    return True


_ADVANCE = {"scroll": _by_scroll, "button-click": _by_button, "auto": _by_whatever_works, "next-url": _by_url}

_STEP = "iter INT, url STRING, refs ARRAY<STRUCT<url:STRING, title_hint:STRING>>, next_url STRING, html_length INT, out_of_time BOOLEAN, failed STRING"


def _steps(open_session: Opener, start: str, spec: dict, limit: int | None, max_iterations: int, stale: int, max_seconds: float | None) -> list[dict]:
    """Steps until a rule for stopping holds; each tells the links that are new, so that a long page isn't told again with each step."""
    began = time.monotonic()
    pause = (spec.get("wait_strategy") or {}).get("after_load_more_ms")
    pause = schemas.WAIT[1] if pause is None else pause
    advance = _ADVANCE.get(spec["pagination"]["method"])
    steps: list[dict] = []
    seen: dict[str, str | None] = {}
    idle = same = 0
    signature = None
    try:
        with _opened(open_session, start) as session:
            url, size = start, len(session.html())
            while len(steps) < max_iterations:
                links = _links(session, url, spec, session.hrefs(link_selector(spec)))
                fresh = {}
                for link in links:
                    clean = kernels.loose(link["url"]) if link["fits"] else None
                    if clean is not None and clean not in seen:
                        fresh.setdefault(clean, link["text"])
                seen |= fresh
                step = {"iter": len(steps) + 1, "url": url, "refs": [{"url": u, "title_hint": t} for u, t in fresh.items()], "next_url": None, "html_length": size, "out_of_time": False, "failed": None}
                steps.append(step)
                idle = 0 if fresh else idle + 1
                same = same + 1 if signature == (url, size, len(seen)) else 0
                signature = (url, size, len(seen))
                ended = (limit and len(seen) >= limit) or idle >= stale or same >= stale
                if ended or advance is None or not advance(session, spec, url, pause):
                    break
                url, size = session.url(), len(session.html())
                step["next_url"] = url
                if max_seconds is not None and time.monotonic() - began > max_seconds:
                    step["out_of_time"] = True
                    break
    except Exception as error:  # noqa: BLE001  a session that fails is a result
        steps.append({"iter": len(steps) + 1, "url": start, "refs": [], "next_url": None, "html_length": 0, "out_of_time": False, "failed": f"{type(error).__name__}: {error}"})
    return steps


def walk(listings: DataFrame, open_session: Opener, max_iterations: int = schemas.MAX_ITERATIONS, limit: int | None = None, stale: int = schemas.STALE_LIMIT, max_seconds: float | None = schemas.MAX_SECONDS) -> DataFrame:
    """listings(listing_id, final_url, spec) -> steps as of collect.walk, with out_of_time and failed."""
    own = listings.select("listing_id", "final_url", "spec").repartition("listing_id")
    return per_page(own, ["listing_id", "spec"], lambda r: _steps(open_session, r["final_url"], r["spec"], limit, max_iterations, stale, max_seconds), _STEP, ["final_url", "spec"])


def spec_facts(pages: DataFrame, keep: list[str], open_session: Opener) -> DataFrame:
    """pages(final_url, html, spec) -> facts as of sources.spec_facts, where links, container and controls are those of the live page,
    and rendered_error, which says why a session could not tell them."""

    def kernel(row: dict) -> dict:
        url, spec, html = row["final_url"], row["spec"] or {}, row["html"]
        live, problem = {"hrefs": [], "bad_links": False, "container": "untold", "paging": "untold", "text_found": False}, None
        try:
            with _opened(open_session, url) as session:
                html = session.html()
                container, paging = spec["listing"].get("container_selector"), spec["pagination"]
                if container:
                    live["container"] = "found" if session.count(container) else "missing"
                live["hrefs"] = _links(session, url, spec, session.hrefs(link_selector(spec)))
                if paging.get("selector"):
                    live["paging"] = "found" if session.count(paging["selector"]) else "missing"
                patterns = paging.get("text_patterns") or []
                live["text_found"] = bool(patterns) and any(p in t for t in _quiet(session.texts, "button, a, [role='button']") for p in patterns)
        except Exception as error:  # noqa: BLE001  a session that fails is a result
            problem = f"{type(error).__name__}: {error}"
        return kernels.spec_facts(html, url, spec) | live | {"container_chars": None, "rendered_error": problem}

    return per_page(pages, keep, kernel, f"{kernels.SPEC_FACTS}, rendered_error STRING", ["final_url", "html", "spec"])


__all__ = ["Opener", "Session", "link_selector", "next_from_template", "spec_facts", "walk"]
