"""The engine on the fixtures of its specification."""

import datetime as dt
import json
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from pagelake import api, schemas
from pagelake.dom import content, markdown, parser, selectors
from pagelake.dom.kernels import resolve as resolve_url
from pagelake.dom.parser import parse, serialize
from pagelake.functions import registry, urls
from pagelake.operators import articles, cache, collect, listing, resolve, snapshot, specs, validate
from pagelake.operators.lineage import checkpoint
from pagelake.plans import queries, sites
from pagelake.sources import pages as sources

LISTING = "<main>" + "".join(f'<article><a href="/posts/{s}"><h2>{s}</h2></a></article>' for s in ("one", "two", "three")) + "<button>Load more</button></main>"
EXCLUDED = "<nav>" + "".join(f'<a href="/tags/{c}">t</a>' for c in "abc") + "</nav><aside>" + "".join(f'<a href="/related/{c}">t</a>' for c in "abc") + "</aside><main><section>" + "".join(f'<a href="/articles/{c}">t</a>' for c in "abcd") + "</section></main>"
LONG = "This is a long paragraph, with commas, that a reader would want to keep. " * 4
URL = "https://example.com/blog"
NOW = dt.datetime(2026, 5, 17, 12)


def pages_of(spark, *rows):
    return sources.from_table(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string"), "never")


def with_spec(spark, pages, spec):
    one = spark.createDataFrame([(spec,)], f"spec {schemas.SPEC}")
    return pages.join(one, how="inner", on=F.lit(True))


def codes(row):
    return [i.code for i in row.issues]


def test_parser_follows_html_rules():
    html = lambda s: serialize(parse(s)).removeprefix("<html><head></head><body>").removesuffix("</body></html>")
    assert html("<p>a<p>b<ul><li>x<li>y</ul>") == "<p>a</p><p>b</p><ul><li>x</li><li>y</li></ul>"
    assert html("<p><b>T.<br><p>n</b>m") == "<p><b>T.<br></b></p><p><b>n</b>m</p>"
    assert parse('<script>var t="</p>";</script>x').text() == 'var t="</p>";x'
    assert html("<a href=1>a<a href=2>b") == '<a href="1">a</a><a href="2">b</a>'
    assert html("&amp;&copy;<!-- c --></nope>") == "&amp;©"
    assert parse(None).text() == "" and parse("<" * 3000).tag == "html"
    assert parse("<div>" * 5000 + "x").text() == "x"


def test_selectors():
    root = parse('<div id="a" class="x Nav"><p>1</p><p class="x">2<a href="/posts/1">l</a></p></div><p>3</p>')
    texts = lambda s: [n.text() for n in selectors.select(root, s)]
    assert texts("p") == ["1", "2l", "3"] and texts("div > p.x") == ["2l"] and texts("#a p, a") == ["1", "2l", "l"]
    assert texts('[class*="nav" i] > p:first-child') == ["1"] and texts('a[href^="/posts"]') == ["l"] and texts("p:not(.x)") == ["1", "3"]
    assert texts("div + p") == ["3"] and texts("p ~ p") == ["2l"] and texts('[class*="nav"]') == [] and texts('a[href=""]') == []
    assert not selectors.is_valid("[") and not selectors.is_valid("") and not selectors.is_valid("a >") and selectors.is_valid(r"div#a\:b")


def test_markdown_and_content():
    assert markdown.html_to_markdown("<h2>A</h2><p>x <b>y</b> <em>z</em><a href=u>v</a></p>") == "## A\n\nx **y** _z_[v](u)"
    assert markdown.html_to_markdown("<ul><li>a<li>b<ul><li>c</ul></ul>") == "- a\n- b\n  - c"
    assert markdown.html_to_markdown("<table><tr><th>a<th>b<tr><td>1|2<td>3</table>") == "| a | b |\n| --- | --- |\n| 1\\|2 | 3 |"
    assert markdown.html_to_markdown('<pre><code class="language-py">a\n\n\n b</code></pre>') == "```py\na\n\n\n b\n```"
    assert markdown.html_to_markdown("<del>a</del><img src=s alt=t><img alt=no><nav>n</nav><li><input type=checkbox checked>d") == "~~a~~![t](s)\n\n[x] d"
    body = content.main_content(parse(f'<nav>{LONG}</nav><div class="sidebar"><p>{LONG}</p></div><article><h1>T</h1><p>{LONG}</p><p>{LONG}</p></article><footer><p>{LONG}</p></footer>'))
    assert body.count("long paragraph") == 8 and "<h1>T</h1>" in body


def test_plain_tags_are_read_as_by_the_tokenizer(monkeypatch):
    pages = [
        '<P Class="a&amp;b" class="c">x<BR>y</P ><a href="/u" x>z</a><b\n>q</b><i id="1"j="2">r', '<style><p id="a"></p></style><title><b></title><p title="">1</p></>', "<ul><li>a<li>b\n\n\n<ol><li>c</ol></ul><table><tr><th>a<td>b\n c</table>",
        "<pre>a \n\n\n b</pre>\t\n <p>``` x</p><p>1. y</p>&lt<svg a='1'/><p a=\"1>2\">z", "<script><b>1</b></script><textarea><p></textarea>",
    ]
    read = lambda: [(serialize(t := parse(p)), [(n.index, n.end) for n in t.descendants()], markdown.html_to_markdown(p)) for p in pages]
    fast = read()
    for name in ("goahead", "parse_starttag", "parse_endtag", "updatepos"):
        monkeypatch.delattr(parser._Builder, name)
    assert read() == fast


def test_markdown_render_runs_on_all_cores(spark, tmp_path):
    """Rows of one row group."""
    rows = [(i, f"n{i}", "b", "t", i) for i in range(2000)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made = sites.markdown_render(spark, str(tmp_path)).select("p_partkey", "markdown", F.spark_partition_id().alias("task")).collect()
    held = Counter(r.task for r in made)
    assert len(held) >= 4 and max(held.values()) < 200
    assert sorted(r.p_partkey for r in made) == list(range(2000)) and all(r.markdown.startswith(f"## n{r.p_partkey}\n\nSize **{r.p_partkey}** of _t_, `b`\n\n- t\n- [see]") for r in made)


def test_url_functions(spark):
    rows = [("https://www.Example.com/alice",), ("https://www.example.com/posts/12345",), ("https://example.com/blog/archive",), ("https://example.com:443/a/b/c.html?x=1#y",), ("https://example.com",), ("not a url",), (None,), ("https://example.com/deadbeef99/x",), ("https://e.com/list?page=4&q=1",), ("https://e.com/list?p=x",)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, u string")
    u = F.col("u")
    got = df.select("i", urls.cache_key(u).alias("key"), urls.normalize_loose(u).alias("loose"), urls.path_pattern(urls.path(u)).alias("pattern"), urls.page_template(u).alias("template"), urls.next_from_template(F.lit("/list?page={n}"), u).alias("next"), urls.request_key(u).alias("request")).orderBy("i").collect()
    assert [r.key for r in got[:3]] == ["example.com__user", "example.com__posts___", "example.com__blog__archive"]
    assert got[3].loose == "https://example.com/a/b/c.html" and got[4].loose == "https://example.com/" and got[5].loose is None is got[6].loose
    assert [r.pattern for r in got[:5]] == ["/alice", "/posts/*", "/blog/*", "/a/b/*", None] and got[7].pattern == "/*/*"
    assert got[8].template == "/list?page={n}&q=1" and got[9].template == "/list?p={n}"
    assert got[8].next == "https://e.com/list?page=5" and got[9].next == "https://e.com/list?page=2"
    assert resolve_url("https://a.com/x/y", "../é b?q=1#f") == "https://a.com/%C3%A9%20b?q=1#f" and resolve_url("https://a.com", "http://[bad") is None
    pattern = df.where("i = 3").select(urls.pattern_regex(F.lit("/a.b/*")).alias("r"), urls.pattern_selector(F.lit("/a.b/*")).alias("s"), urls.pattern_selector(F.lit("/*")).alias("t")).first()
    assert (pattern.r, pattern.s, pattern.t) == (r"/a\.b/[^/]+/?$", 'a[href*="/a.b/"]', "a[href]")


def test_listing_analysis(spark):
    pages = pages_of(spark, (URL, LISTING), (URL, EXCLUDED), (URL + "?page=2", EXCLUDED), (URL, f'<body class="has-sidebar">{LISTING}</body>'), (URL, None), (URL, '<link rel=next href="/p/2"><div class="feed">' + LISTING.replace("<button>Load more</button>", "") + "</div>"))
    rows = {r.page_id: r for r in listing.analyze(sources.listing_facts(pages)).collect()}
    a = rows[0]
    assert a.spec.listing.article_link_selector == 'a[href*="/posts/"]' and a.spec.listing.article_link_href_pattern == "/posts/[^/]+/?$"
    assert a.spec.pagination.method == "auto" and len(a.article_links) == 1 and a.article_links[0].score == pytest.approx(0.85) and a.confidence == pytest.approx(0.973)
    assert a.spec.listing.container_selector == "main"
    assert rows[1].article_links[0].selector == 'a[href*="/articles/"]' and rows[1].article_links[0]["count"] == 4 and rows[1].article_links[0].score == pytest.approx(0.95)
    assert rows[1].confidence == pytest.approx(0.95) and rows[1].spec.pagination.method == "none" and rows[2].spec.pagination.url_template == "/blog?page={n}"
    assert rows[3].spec is None and rows[4].spec is None and rows[3].error == "no links of one pattern"
    assert [p.score for p in rows[5].pagination] == [0.95, 0.45] and rows[5].pagination[0].selector == 'link[rel="next"]'


def test_nodes_are_intervals(spark):
    pages = pages_of(spark, (URL, EXCLUDED))
    nodes = sources.dom_nodes(pages)
    roots = nodes.where("tag IN ('nav', 'aside')").select("page_id", F.col("node_id").alias("lo"), F.col("end_id").alias("hi"))
    kept = nodes.join(roots, (nodes.page_id == roots.page_id) & nodes.node_id.between(F.col("lo"), F.col("hi")), "left_anti")
    facts = sources.listing_facts(pages).first()
    assert kept.where("tag = 'a'").count() == len(facts.links) == 4 and facts.n_links == 10 and facts.n_excluded == 6


@pytest.mark.parametrize(
    "html,spec,want",
    [
        (LISTING, dict(container="main", excludes=["nav", "footer"], pagination="button-click", pagination_selector="button", text_patterns=["Load more"]), []),
        (LISTING, dict(link="["), ["invalid-article-link-selector"]),
        (LISTING, dict(pattern="/articles/[^/]+/?$"), ["matching-url-count-too-low"]),
        (LISTING, dict(pattern="("), ["invalid-href-pattern"]),
        (LISTING, dict(container=".none", excludes=["["]), ["invalid-exclude-selector", "container-selector-empty", "invalid-exclude-selector"]),
        (LISTING, dict(container="["), ["invalid-container-selector"]),
        (LISTING + '<p class="e"></p>', dict(method="selector", content=".e"), ["content-selector-not-plausible"]),
        (LISTING, dict(method="selector"), ["missing-content-selector"]),
        (LISTING, dict(method="selector", content="["), ["invalid-content-selector"]),
        (LISTING, dict(pagination="next-url"), ["missing-pagination-selector"]),
        (LISTING, dict(pagination="next-url", url_template="/b?page={n}"), []),
        (LISTING, dict(pagination="next-url", pagination_selector=".none"), ["pagination-selector-empty"]),
        (LISTING, dict(pagination="button-click", pagination_selector="["), ["invalid-pagination-selector"]),
        (LISTING + "".join(f'<a href="/x/{i}">x</a>' for i in range(9)), dict(link="a[href]"), ["href-pattern-too-broad-or-mismatched"]),
        ('<div class="c"></div>', dict(container=".c"), ["article-link-count-too-low", "matching-url-count-too-low", "container-selector-empty-content"]),
    ],
)
def test_validation_rules(spark, html, spec, want):
    made = schemas.spec_value(spec.pop("link", 'a[href*="/posts/"]'), spec.pop("pattern", "/posts/[^/]+/?$"), **spec)
    row = validate.validate(with_spec(spark, pages_of(spark, (URL, html)), made)).first()
    assert codes(row) == want and row.valid == (not want)
    if not want:
        assert (row.link_count, row.unique_url_count) == (3, 3)


def spec_json(**changes):
    spec = {"listing": {"articleLinkSelector": 'a[href*="/posts/"]', "articleLinkHrefPattern": "/posts/[^/]+/?$"}, "article": {"method": "readability"}, "pagination": {"method": "none"}, "evidence": "e"}
    return json.dumps(spec | changes)


def test_spec_schema(spark):
    texts = [spec_json(), f"Here:\n```json\n{spec_json()}\n```", "not-json", "```\n{x\n```", spec_json(article={"method": "selector"}), spec_json(pagination={"method": "button-click"}), spec_json(waitStrategy={"afterNavigation": "load", "afterLoadMoreMs": 1.5, "maxWaitMs": 1}), spec_json(evidence=""), spec_json() + "x", None, "[1]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, json string")
    rows = [r for r in specs.parse_specs(df).orderBy("i").collect()]
    assert [r.spec is not None for r in rows] == [True, True] + [False] * 9
    assert rows[2].spec_error == "response was not valid JSON" and "fence" in rows[3].spec_error and "contentSelector is required" in rows[4].spec_error
    assert "textPatterns" in rows[5].spec_error and rows[6].spec_error.count("integer") == 2 and "evidence" in rows[7].spec_error
    assert rows[0].spec.listing.article_link_selector == 'a[href*="/posts/"]'
    again = specs.parse_specs(specs.parse_specs(df.where("i = 0")).select(specs.to_json(F.col("spec")).alias("json"))).first()
    assert again.spec == rows[0].spec


def test_cache_life(spark, tmp_path):
    pages = pages_of(spark, (URL, LISTING))
    spec = schemas.spec_value('a[href*="/posts/"]', "/posts/[^/]+/?$")
    at = lambda days: F.lit(NOW + dt.timedelta(days=days))
    resolved = with_spec(spark, pages, spec).withColumn("valid", F.lit(True))
    entries = cache.save(cache.empty(spark), resolved, at(0))
    assert entries.count() == 1 and cache.save(cache.empty(spark), resolved.withColumn("valid", F.lit(False)), at(0)).count() == 0
    reason = lambda e, p=pages, d=1, **o: cache.lookup(p, e, at(d), **o).first()
    hit = reason(entries)
    assert hit.reason == "hit" and hit.unique_url_count == 3 and hit.spec is not None
    moved = cache.after_lookup(entries, cache.lookup(pages, entries, at(1)), at(1)).first()
    assert (moved.hit_count, moved.zero_result_count, moved.last_used_at) == (1, 0, NOW + dt.timedelta(days=1))
    assert reason(entries, refresh=True).message == "cache bypassed" and reason(entries, d=45).reason == "stale" and reason(entries, d=30).reason == "hit"
    assert reason(cache.empty(spark)).reason == "miss"
    failed = reason(entries, pages_of(spark, (URL, "<p>nothing</p>")))
    assert failed.reason == "validation-failed" and failed.spec is None and "article-link-count-too-low" in failed.message
    once = cache.record_zero_result(entries, entries, 2)
    twice = cache.record_zero_result(once, entries, 2)
    assert [(r.zero_result_count, r.validation_status) for r in (once.first(), twice.first())] == [(1, "verified"), (2, "stale")]
    for name, text in (("example.com__blog.json", cache.to_files(entries).first().content), ("bad.json", "{not-json"), ("short.json", '{"cacheKey":"x"}')):
        (tmp_path / name).write_text(text)
    files = {r.cache_key: r.problem for r in cache.read_files(spark, f"file://{tmp_path}").collect()}
    assert files == {"example.com__blog": None, "bad": "corrupt", "x": "invalid"}
    assert reason(cache.read_files(spark, f"file://{tmp_path}")).reason == "hit"


def test_cascade(spark):
    pages = pages_of(spark, (URL, LISTING), ("https://other.com/x", "<main><p>No links</main>"))
    rows = {r.page_id: r for r in resolve.resolve(pages, cache.empty(spark), F.lit(NOW)).collect()}
    assert rows[0].source == "heuristic" and rows[0].valid and rows[1].source is None and "no provider" in rows[1].error
    assert any("no links of one pattern" in x for x in rows[1].explanation)
    found = resolve.resolve(pages, cache.empty(spark), F.lit(NOW))
    entries = checkpoint(cache.save(cache.empty(spark), found, F.lit(NOW)))
    again = {r.page_id: r for r in resolve.resolve(pages, entries, F.lit(NOW)).collect()}
    assert again[0].source == "cache" and "  key example.com__blog, 3 URLs fit" in again[0].explanation
    fresh = resolve.resolve(pages.where("page_id = 0"), entries, F.lit(NOW), refresh=True).first()
    assert fresh.source == "heuristic" and "cache: miss, cache bypassed" in fresh.explanation


def scripted(*replies):
    """A provider whose reply depends on what the prompt tells of the reply before."""

    def provider(prompt):
        for k in range(len(replies) - 1, 0, -1):
            if replies[k - 1][:30] in prompt.split("Listing page ")[0]:
                return replies[k]
        return replies[0]

    return provider


def test_provider_attempts(spark):
    html = "<div>" + "".join(f'<a href="/posts/{i}">x</a>' for i in "ab") + '<a href="/posts/c"></a></div>'
    pages = pages_of(spark, (URL, "<nav>" + html + "</nav>"))
    good, wrong = spec_json(), json.dumps({"listing": {"articleLinkSelector": "a", "articleLinkHrefPattern": "/nope/"}, "article": {"method": "readability"}, "pagination": {"method": "none"}, "evidence": "wrong"})
    ask = lambda *replies, retries=2: resolve.resolve(pages, cache.empty(spark), F.lit(NOW), provider=scripted(*replies), max_retries=retries).first()
    first = ask(good)
    assert first.source == "provider" and first.error is None and sum("asked" in x for x in first.explanation) == 1
    second = ask("not-json", good)
    assert second.source == "provider" and any("unreadable" in x for x in second.explanation)
    third = ask(wrong, good)
    assert third.source == "provider" and any("fails on the page" in x for x in third.explanation)
    never = ask("not-json", "not-json", retries=1)
    assert never.spec is None and "none of 2 replies" in never.error


def test_pages_that_cannot_be_read_end_no_job(spark):
    odd = ["<blockquote>" * 300 + "x" * 90, "<em>" * 1000 + "y", "<p><b>" * 200 + "z", "<b><i>" * 500, None, "<" * 5000, "<ul><li>" * 400 + "w"]
    pages = pages_of(spark, *[(URL, html) for html in odd])
    began = time.time()
    rows = {r.page_id: r.article for r in articles.extract(pages).collect()}
    assert time.time() - began < 20 and len(rows) == len(odd)
    assert rows[0].markdown.endswith("x" * 90) and rows[1].markdown and rows[4].error == f"nothing to extract at {URL}"
    assert len([*parse("<p><b>" * 200).descendants()]) < 1500
    failing = sources.per_page(pages, ["page_id"], lambda r: {"n": len(r["html"])} if r["html"] is not None else {"n": -1}, "n INT", ["html"])
    assert {r.page_id: r.n for r in failing.collect()}[4] == -1
    broken = sources.per_page(pages, ["page_id"], lambda r: 1 / 0, "n INT", ["html"], lambda r, error: {"n": None})
    assert broken.count() == len(odd)


@pytest.mark.parametrize("pattern,ok,fits", [("(?P<x>/posts/)", False, 0), (r"^/posts/(?<y>\w+)$", True, 3), ("[", False, 0), ("(", False, 0), (r"/posts/(?=one)", True, 1), (r"(?<!x)/posts/", True, 3)])
def test_patterns_are_judged_and_applied_by_one_engine(spark, pattern, ok, fits):
    pages = with_spec(spark, pages_of(spark, (URL, LISTING)), schemas.spec_value('a[href*="/posts/"]', pattern))
    row = validate.validate(pages).first()
    assert ("invalid-href-pattern" in codes(row)) == (not ok) and row.unique_url_count == fits
    step = collect.page_refs(sources.spec_facts(pages, ["page_id"]), ["page_id"]).first()
    assert len(step.refs) == fits


def test_html_moves_only_to_be_fetched(spark):
    """Of all plans of a walk and a fetch, only where very many keys are asked for is there an exchange of HTML."""
    pages = site(spark)
    refs = pages.select(F.col("final_url").alias("url"))
    plan = articles.fetched(refs, pages)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    found = sources.of_pages(pages.select("page_id", "final_url"), pages, "final_url")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in found and "Exchange hashpartitioning" not in found and moved


def site(spark):
    post = lambda i: (f"https://site.test/posts/river-{i}", f"<html><head><title>Site</title></head><body><article><h1>Note on Rivers {i}</h1><time datetime='2026-05-0{i}T00:00:00Z'></time><p>Body sentence {i}. {LONG}</p><p>{LONG}</p></article></body></html>")
    links = lambda ids: "<main>" + "".join(f'<article><a href="/posts/river-{i}">River {i}</a></article>' for i in ids) + "</main>"
    return pages_of(spark, ("https://site.test/blog", links((1, 2, 3)) + '<a rel="next" href="/blog/page/2">Next</a>'), ("https://site.test/blog/page/2", links((4, 5))), *[post(i) for i in range(1, 6)])


def test_collection(spark):
    pages = site(spark)
    start = pages.where("page_id = 0").withColumnRenamed("page_id", "listing_id")
    paged = with_spec(spark, start, schemas.spec_value('a[href*="/posts/"]', "/posts/[^/]+/?$", pagination="next-url", pagination_selector='a[rel="next"]'))
    got = collect.collect(paged, pages, 10).first()
    assert (got.iterations, got.stopped_because, [x.url[-1] for x in got.links]) == (2, "complete", list("12345")) and got.links[0].title_hint == "River 1"
    limited = collect.collect(paged, pages, 4).first()
    assert (limited.stopped_because, len(limited.links)) == ("limit", 4)
    single = collect.collect(with_spec(spark, start, schemas.spec_value('a[href*="/posts/"]', "/posts/[^/]+/?$")), pages).first()
    assert (single.iterations, single.stopped_because, len(single.links)) == (1, "complete", 3)
    assert collect.collect(paged, pages, None, 1).first().stopped_because == "max-iterations"
    loop = pages_of(spark, *[(f"https://l.test/{i}", f'<a href="/posts/a">a</a><a rel=next href="/{(i + 1) % 9}">n</a>') for i in range(9)])
    start = with_spec(spark, loop.where("page_id = 0").withColumnRenamed("page_id", "listing_id"), schemas.spec_value('a[href*="/posts/"]', ".", pagination="next-url", pagination_selector="a"))
    stopped = collect.collect(start, loop).first()
    assert (stopped.stopped_because, stopped.iterations, len(stopped.links)) == ("duplicates", 6, 1)
    diff = spark.createDataFrame([(["a"], ["a", "b"]), (["a"], ["a"]), (["a"], ["a", "a"])], "b array<string>, a array<string>").select(collect.moved_on(F.col("b"), F.col("a")).alias("m")).collect()
    assert [r.m for r in diff] == [True, False, True]


def test_download_end_to_end(spark, tmp_path):
    pages = site(spark)
    result = api.download(pages.where("page_id = 0"), pages, as_of=F.lit(NOW), limit=5)
    files = {r.filename: r.content for r in result.files.collect()}
    assert sorted(files) == [f"Note_on_Rivers_{i}.md" for i in range(1, 6)]
    assert files["Note_on_Rivers_2.md"].startswith('---\ntitle: "Note on Rivers 2"\ndate: 2026-05-02\nsource: https://site.test/posts/river-2\n---\n\n# Note on Rivers 2\n\n') and "Body sentence 2." in files["Note_on_Rivers_2.md"]
    assert tuple(result.summary.first()) == (5, 0, [])
    assert articles.write_files(result.files, str(tmp_path)) == 5 and (tmp_path / "Note_on_Rivers_1.md").read_text() == files["Note_on_Rivers_1.md"]
    seen = api.inspect(pages.where("page_id = 0"), pages, as_of=F.lit(NOW))
    found, preview = seen.resolution.first(), seen.preview.first()
    assert found.source == "heuristic" and found.spec.pagination.method == "next-url" and len(preview.links) == 5 and preview.stopped_because == "complete"
    given = api.inspect(pages.where("page_id = 0"), pages, spec=spark.createDataFrame([(spec_json(),)], "json string"))
    assert given.resolution.first().valid and given.preview.first().stopped_because == "complete"
    for source, hits in (("heuristic", 0), ("cache", 1), ("cache", 2)):
        run = api.download(pages.where("page_id = 0"), pages, as_of=F.lit(NOW), limit=5, cache_path=f"file://{tmp_path}/cache")
        assert run.resolution.first().source == source and cache.load(spark, f"file://{tmp_path}/cache").first().hit_count == hits
    alone = api.download(pages.where("page_id = 3"), pages, as_of=F.lit(NOW))
    assert [r.filename for r in alone.files.collect()] == ["Note_on_Rivers_2.md"]
    gone = api.download(pages.where("page_id = 0"), pages.where("page_id <> 4"), as_of=F.lit(NOW))
    summary = gone.summary.first()
    assert (summary.succeeded, summary.failed, summary.errors[0].url) == (4, 1, "https://site.test/posts/river-3")
    with pytest.raises(ValueError, match="positive integer"):
        api.download(pages, pages, limit=0)
    with pytest.warns(UserWarning, match="ignored"):
        assert api.download(pages.where("page_id > 1"), pages, limit=3, current_page=True).files.count() == 5


def test_names_and_summary(spark):
    bases = ["x", "x", "x-2", "x", "", "y", "x-2", 'q"/:<>|z  w', "l" * 150]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(bases)], "i int, title string").withColumn("base", articles.file_base(F.col("title")))
    names = [r.filename for r in articles.unique_names(df, ["i"]).orderBy("i").collect()]
    assert names == ["x.md", "x-3.md", "x-2.md", "x-4.md", ".md", "y.md", "x-2-2.md", "qz_w.md", "l" * 100 + ".md"] and len(set(names)) == 9
    have = spark.createDataFrame([("y.md",), ("y-2.md",)], "filename string")
    assert [r.filename for r in articles.unique_names(df.where("title = 'y'"), ["i"], existing=have).collect()] == ["y-3.md"]
    rows = spark.createDataFrame([(0, "a", "saved", None), (1, "b", "failed", "timeout"), (2, "c", "saved", None)], "pos int, url string, status string, error string")
    assert tuple(articles.summary(rows).first()) == (2, 1, [("b", "timeout")]) and tuple(articles.summary(rows.limit(0)).first()) == (0, 0, [])


def test_snapshot_and_requests(spark):
    pages = pages_of(spark, (URL, '<div><div id="m" class="a b c d" role="main" aria-label="L"><a href="/p?q=1">go</a><script>x</script><span></span></div></div>'), (URL, "<p>x</p>" * 2000))
    shots = {r.page_id: r for r in snapshot.snapshots(pages).collect()}
    assert shots[0].snapshot.split("\n") == ["<body>", '    <div #m .a.b.c role="main" aria="L">', '      <a href="/p?..." "go">']
    assert shots[1].n_nodes == 2001 and len(shots[1].snapshot.split("\n")) == 1500
    found = resolve.resolve(pages, cache.empty(spark), F.lit(NOW)).join(pages.select("page_id", "html"), "page_id")
    bundle = {r.page_id: r for r in snapshot.agent_requests(found, ("API_KEY",)).collect()}
    made = json.loads(bundle[0].content)
    assert bundle[0].name == "example.com__blog.json" and made["missingLlmConfig"] == ["API_KEY"] and "Listing page " + URL in made["userPrompt"]


def test_listing_outline_is_whole(spark, tmp_path):
    """A listing page of more elements than a prompt's snapshot reads or keeps."""
    spark.range(3200).selectExpr("id AS page_id", "concat('http://h.test/p/', id) AS url", "'' AS html").write.parquet(f"{tmp_path}/pages.parquet")
    row = sites.listing_outline(spark, str(tmp_path)).first()
    assert row.n_nodes == 3202 and row.snapshot.split("\n") == ["<body>", "  <main>", *(f'    <a href="/p/{i}" "x">' for i in range(3200))]


def by_sql(folder, name):
    """What DuckDB makes of a query's SQL over the pages of a folder."""
    with duckdb.connect() as base:
        base.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
        return sorted(base.execute(queries.oracle_sql()[name]).fetchall())


@pytest.fixture(scope="module")
def titled(spark, tmp_path_factory):
    """Pages whose titles hold references that SQL knows, others, and cut ones."""
    folder = str(tmp_path_factory.mktemp("titled"))
    titles = ["a &lt;b&gt; &amp;", "x &quot;y", "x &quot;y", "and&amp", "R&D &copy; &#65; &eacute", "&amp;lt; &amp;quot;", 'q "z" &', "&lt&gt", "plain"]
    rows = [(i, f"https://e.test/{i}", f"<title>t</title><article><h1>{t}</h1><p>{LONG}</p></article>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


def test_article_title_is_as_in_sql(spark, titled):
    assert sorted(map(tuple, queries.article_title(spark, titled).collect())) == by_sql(titled, "article_title")
    assert articles.extract(queries.pages(spark, titled)).where("page_id = 1").first().article.title == 'x "y'  # the operator reads all references


def test_article_frontmatter_is_as_in_sql(spark, titled):
    assert sorted(map(tuple, queries.article_frontmatter(spark, titled).collect())) == by_sql(titled, "article_frontmatter")


def test_filename_unique_is_as_in_sql(spark, titled):
    assert sorted(map(tuple, queries.filename_unique(spark, titled).collect())) == by_sql(titled, "filename_unique")


def test_sources_and_functions(spark, tmp_path):
    (tmp_path / "one.html").write_text("<h1>One</h1><p>é</p>")
    page = sources.from_dir(spark, f"file://{tmp_path}", "https://d.test/").first()
    assert page.final_url == "https://d.test/one.html" and "é" in page.html
    urls_df = spark.createDataFrame([(1, "u1"), (2, "boom")], "page_id long, url string")

    def fetch(url):
        if url == "boom":
            raise OSError("no")
        return url + "/final", 404, "<p>x</p>"

    got = {r.page_id: r for r in sources.from_fetcher(urls_df, fetch).collect()}
    assert (got[1].final_url, got[1].status, got[2].status) == ("u1/final", 404, 0)
    heavy = "<script></script>" * 8 + "<p>x</p>"
    plan = sources.render_plan(sources.from_table(spark.createDataFrame([(0, URL, heavy), (1, URL, "<p>x</p>"), (2, URL, '<div id="root">'), (3, URL, None)], "page_id long, url string, html string"))).orderBy("page_id").collect()
    assert [r.render for r in plan] == [True, False, True, False]
    with pytest.raises(ValueError):
        sources.from_table(urls_df, "sometimes")
    registry.register(spark)
    pages_of(spark, (URL, LISTING)).createOrReplaceTempView("p")
    assert spark.sql("SELECT l.url FROM p, LATERAL html_links(html, final_url) l ORDER BY pos").first().url == "https://example.com/posts/one"
    assert spark.sql("SELECT count(*) n FROM p, LATERAL html_nodes(html) WHERE tag = 'article'").first().n == 3
    assert spark.sql("SELECT html_to_markdown('<h1>a</h1>') m, url_resolve('https://a.com/b/', 'c') u").first() == ("# a", "https://a.com/b/c")
    assert sources.from_html(spark, URL, "x").first().source == "rendered"


def test_streams(spark, tmp_path):
    from pagelake.streaming import jobs

    pages = site(spark)
    pages.write.parquet(f"{tmp_path}/in")
    pages.write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(pages.schema).parquet(f"{tmp_path}/in")
    query = jobs.article_stream(stream).writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.sql("SELECT count(*) n, count(DISTINCT final_url) d FROM seen").first() == (7, 7)
    links = jobs.link_stream(spark.readStream.schema(pages.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("links").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    links.awaitTermination(120)
    assert spark.sql("SELECT count(*) n FROM links").first().n == 6
    entries = cache.save(cache.empty(spark), with_spec(spark, pages.where("page_id = 0"), schemas.spec_value("a", ".")).withColumn("valid", F.lit(True)), F.lit(NOW))
    entries.write.parquet(f"{tmp_path}/cache/base")
    spark.createDataFrame([("site.test__blog", "hit"), ("site.test__blog", "hit")], "cache_key string, reason string").write.parquet(f"{tmp_path}/looked")
    looked = spark.readStream.schema("cache_key string, reason string").parquet(f"{tmp_path}/looked")
    jobs.cache_stream(looked, f"{tmp_path}/cache", F.lit(NOW), f"{tmp_path}/c3").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/cache/generation=0").first().hit_count == 2
