"""Listings walked and specs validated through scripted sessions."""

import pytest
from pyspark.sql import functions as F

from pagelake import api, schemas
from pagelake.operators import collect, rendered, validate
from pagelake.sources import pages as sources

START = "https://harbour.test/log"
LINK, PATTERN = "a.entry", "/log/[a-z]+/?$"


def scripted(batches, opens=(), broken=None, moves=True):
    """Opens sessions on a page whose links come in batches; `opens` names the actions that bring the next one."""

    class Scripted:
        def __init__(self, url):
            self.at, self.shown, self.waited = url, 1, 0
            if broken == "open":
                raise OSError("no browser")

        def _more(self, action):
            if action not in opens or self.shown >= len(batches):
                return False
            self.shown += 1
            return True

        def _links(self):
            return [x for batch in batches[: self.shown] for x in batch]

        def count(self, selector):
            return 0 if selector == ".none" else 1

        def texts(self, selector):
            if broken == "texts":
                raise ValueError("gone")
            return ["More entries"] if "button" in selector else [f"Entry {x}" for x in self._links()]

        def hrefs(self, selector):
            if broken == "hrefs" and self.shown > 1 or broken == "first":
                raise ValueError("page closed")
            if selector == "a.next":
                return [] if "2" in self.at else ["/log?from=3", "/other"]
            return [f"/log/{x}#top" for x in self._links()]

        def click(self, selector):
            return self._more("click")

        def click_text(self, patterns):
            return self._more("text")

        def click_candidate(self, selector):
            return self._more("candidate")

        def scroll(self):
            self._more("scroll")

        def wait(self, milliseconds):
            self.waited += milliseconds

        def html(self):
            return f"<main>{'x' * self.shown}</main>"

        def url(self):
            return self.at

        if moves:

            def navigate(self, url):
                self.at = url
                return self._more("url")

    return Scripted


def listings(spark, method, **paging):
    spec = schemas.spec_value(LINK, PATTERN, container="main", pagination=method, **paging)
    return spark.createDataFrame([(7, START, "<main></main>", spec)], f"listing_id long, final_url string, html string, spec {schemas.SPEC}")


BATCHES = [["ada", "bea"], ["bea", "cleo"], ["dot"]]


@pytest.mark.parametrize(
    "method,paging,opens,rules,want,why",
    [
        ("scroll", {}, ("scroll",), {}, ["ada", "bea", "cleo", "dot"], "duplicates"),
        ("button-click", {"pagination_selector": "button"}, ("click",), {}, ["ada", "bea", "cleo", "dot"], "duplicates"),
        ("button-click", {"pagination_selector": "button", "text_patterns": ["More"]}, ("text",), {}, ["ada", "bea", "cleo", "dot"], "duplicates"),
        ("button-click", {"pagination_selector": "button"}, ("scroll",), {}, ["ada", "bea", "cleo", "dot"], "duplicates"),
        ("auto", {}, ("candidate",), {}, ["ada", "bea", "cleo", "dot"], "duplicates"),
        ("auto", {}, (), {}, ["ada", "bea"], "duplicates"),
        ("scroll", {}, ("scroll",), {"limit": 3}, ["ada", "bea", "cleo"], "limit"),
        ("scroll", {}, ("scroll",), {"max_iterations": 2}, ["ada", "bea", "cleo"], "max-iterations"),
        ("scroll", {}, ("scroll",), {"max_seconds": 0.0}, ["ada", "bea"], "max-time"),
        ("none", {}, ("scroll",), {}, ["ada", "bea"], "complete"),
        ("next-url", {"url_template": "/log?page={n}"}, ("url",), {"max_iterations": 3}, ["ada", "bea", "cleo", "dot"], "complete"),
        ("next-url", {"pagination_selector": "a.next"}, ("url",), {}, ["ada", "bea"], "complete"),
    ],
)
def test_walks(spark, method, paging, opens, rules, want, why):
    got = collect.collect(listings(spark, method, **paging), None, open_session=scripted(BATCHES, opens), **{"limit": None, **rules}).first()
    assert ([x.url for x in got.links], got.stopped_because) == ([f"https://harbour.test/log/{x}" for x in want], why)
    assert got.links[0].title_hint == "Entry ada"


def test_sessions_that_fail_end_their_own_walk(spark):
    two = listings(spark, "scroll").union(listings(spark, "scroll").withColumn("listing_id", F.lit(8).cast("long")).withColumn("final_url", F.lit("https://harbour.test/b")))
    good, bad = scripted(BATCHES, ("scroll",)), scripted(BATCHES, ("scroll",), "hrefs")
    got = {r.listing_id: r for r in collect.collect(two, None, None, open_session=lambda url: good(url) if url == START else bad(url)).collect()}
    assert (got[7].stopped_because, len(got[7].links)) == ("duplicates", 4) and (got[8].stopped_because, len(got[8].links)) == ("failed", 2)
    assert collect.collect(listings(spark, "scroll"), None, open_session=scripted(BATCHES, (), "open")).first().stopped_because == "failed"
    hints = collect.collect(listings(spark, "none"), None, open_session=scripted(BATCHES, (), "texts")).first().links
    assert len(hints) == 2 and hints[0].title_hint is None
    still = collect.collect(listings(spark, "next-url", url_template="/log?page={n}"), None, open_session=scripted(BATCHES, ("url",), moves=False)).first()
    assert (still.iterations, still.stopped_because) == (1, "complete")


def test_templates():
    assert rendered.next_from_template("/a?page={n}", START + "?page=4") == "https://harbour.test/a?page=5"
    assert rendered.next_from_template("/a/{n}", START + "?p=x") == "https://harbour.test/a/2"
    assert rendered.next_from_template("/a/{n}", START) == "https://harbour.test/a/2"


def test_validation_on_the_live_page(spark):
    def issues(broken=None, batches=([*"abc"],), **changes):
        spec = schemas.spec_value(LINK, PATTERN, **{"container": "main", "pagination": "button-click", "pagination_selector": "button", **changes})
        pages = spark.createDataFrame([(1, START, "<p>built by scripts</p>", spec)], f"page_id long, final_url string, html string, spec {schemas.SPEC}")
        row = validate.validate(pages, open_session=scripted(list(batches), (), broken)).first()
        return row.valid, [i.code for i in row.issues], row.link_count

    assert issues() == (True, [], 3)
    assert issues(container=".none") == (False, ["container-selector-empty"], 3)
    assert issues("first") == (False, ["rendered-article-link-validation-failed"], 0)
    assert issues(pagination_selector=".none") == (False, ["pagination-selector-empty"], 3)
    assert issues(pagination_selector=".none", text_patterns=["More"]) == (True, [], 3)
    assert issues(batches=([*"ab"],))[1] == ["article-link-count-too-low", "matching-url-count-too-low"]


def test_time_limit_of_a_walk_over_tables(spark):
    table = spark.createDataFrame([(i, f"https://l.test/{i}", f'<a href="/posts/{"abc"[i]}">t</a><a rel=next href="/{i + 1}">n</a>') for i in range(3)], "page_id long, url string, html string")
    pages = sources.from_table(table, "never")
    spec = schemas.spec_value('a[href*="/posts/"]', ".", pagination="next-url", pagination_selector="a[rel=next]")
    start = pages.where("page_id = 0").select(F.col("page_id").alias("listing_id"), "final_url", "html").join(spark.createDataFrame([(spec,)], f"spec {schemas.SPEC}"))
    assert [collect.collect(start, pages, max_seconds=s).first().stopped_because for s in (None, 0.0)] == ["complete", "max-time"]


def test_download_through_sessions(spark):
    body = "<article><h1>Entry {0}</h1><p>" + "A line of the log, long enough to be kept. " * 8 + "</p></article>"
    listing = "<main>" + "".join(f'<a class="entry" href="/log/{x}">Entry {x}</a>' for x in ("ada", "bea", "cleo")) + "<button>More</button></main>"
    rows = [(0, START, listing), *[(i, f"https://harbour.test/log/{x}", body.format(x)) for i, x in enumerate(("ada", "bea", "cleo", "dot"), 1)]]
    pages = sources.from_table(spark.createDataFrame(rows, "page_id long, url string, html string"), "never")
    done = api.download(pages.where("page_id = 0"), pages, as_of=F.current_timestamp(), open_session=scripted([["ada", "bea", "cleo"], ["dot"]], ("candidate", "scroll", "click", "text")))
    assert sorted(r.filename for r in done.files.collect()) == [f"Entry_{x}.md" for x in ("ada", "bea", "cleo", "dot")]
    assert api.exit_code(done) == 0
    gone = api.download(pages.where("page_id = 0"), pages.where("page_id <> 2"), as_of=F.current_timestamp())
    assert api.exit_code(gone) == 1


def test_fetching_waits_between_pages_of_a_task(spark):
    import time

    urls = spark.createDataFrame([(i, f"u{i}") for i in range(3)], "page_id long, url string").coalesce(1)
    began = time.time()
    assert sources.from_fetcher(urls, lambda url: (url, 200, ""), delay=0.3).count() == 3
    assert time.time() - began > 0.6
