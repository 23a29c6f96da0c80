"""Validation of specs against pages: facts from one parse, rules as column expressions, a page's issues as one array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import urls
from ..sources import pages as sources
from . import rendered


def issue(when: Column, code: str, message: Column | str, selector: Column | None = None) -> Column:
    made = F.struct(F.lit("error").alias("severity"), F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"), (selector if selector is not None else F.lit(None).cast("string")).alias("selector"))
    return F.when(F.coalesce(when, F.lit(False)), made)


def link_stats(hrefs: Column) -> tuple[Column, Column, Column]:
    """Links, links whose path fits the pattern, and distinct URLs among these."""
    matching = F.filter(F.transform(F.filter(hrefs, lambda h: h["fits"]), lambda h: urls.normalize_loose(h["url"])), lambda u: u.isNotNull())
    return F.size(hrefs), F.size(matching), F.size(F.array_distinct(matching))


def rule_issues(n_links: Column, n_matching: Column, n_unique: Column, selector: Column, pattern_ok: Column | None = None) -> list[Column]:
    """The rules on counts of links."""
    ok = F.lit(True) if pattern_ok is None else pattern_ok
    least = schemas.MIN_CLUSTER
    return [
        issue(ok & (n_links < least), "article-link-count-too-low", F.concat(n_links.cast("string"), F.lit(f" links selected, {least} are needed")), selector),
        issue(ok & (n_unique < least), "matching-url-count-too-low", F.concat(n_unique.cast("string"), F.lit(f" different URLs fit the pattern, {least} are needed")), selector),
        issue(ok & (n_matching > 0) & (n_matching / F.greatest(n_links, F.lit(1)) < 0.5), "href-pattern-too-broad-or-mismatched", F.concat(n_matching.cast("string"), F.lit(" of "), n_links.cast("string"), F.lit(" selected links fit the pattern")), selector),
    ]


def is_valid(issues: Column) -> Column:
    return F.forall(issues, lambda i: i["severity"] != "error")


def validate(pages: DataFrame, keep: list[str] | None = None, open_session: rendered.Opener | None = None) -> DataFrame:
    """pages(page_id, final_url, html, spec) -> the columns `keep`, valid, issues, link_count, unique_url_count.

    With open_session, links, container and controls are judged on the rendered page."""
    keep = keep or ["page_id"]
    own = list(dict.fromkeys([*keep, "spec"]))
    facts = sources.spec_facts(pages, own).withColumn("rendered_error", F.lit(None).cast("string")) if open_session is None else rendered.spec_facts(pages, own, open_session)
    listing, article, paging = F.col("spec.listing"), F.col("spec.article"), F.col("spec.pagination")
    link, pattern, container = listing["article_link_selector"], listing["article_link_href_pattern"], listing["container_selector"]
    n_links, n_matching, n_unique = link_stats(F.col("hrefs"))
    facts = facts.withColumns({"n_links": n_links, "n_matching": n_matching, "n_unique": F.when(F.col("pattern_ok"), n_unique).otherwise(0)})
    good = ~F.col("bad_links") & F.col("rendered_error").isNull()
    bad = F.transform("bad_excludes", lambda s: F.struct(F.lit("error").alias("severity"), F.lit("invalid-exclude-selector").alias("code"), F.concat(F.lit("not a selector: "), s).alias("message"), s.alias("selector")))
    by_selector = article["method"] == "selector"
    content = article["content_selector"]
    needs = paging["method"].isin("button-click", "next-url") & ~((paging["method"] == "next-url") & paging["url_template"].isNotNull())
    rules = [
        issue(F.col("container") == "missing", "container-selector-empty", "no such container", container),
        issue(F.col("container") == "invalid", "invalid-container-selector", F.concat(F.lit("not a selector: "), container), container),
        issue(F.col("bad_links"), "invalid-article-link-selector", F.concat(F.lit("not a selector: "), link), link),
        issue(good & ~F.col("pattern_ok"), "invalid-href-pattern", F.concat(F.lit("not a pattern: "), pattern)),
        *rule_issues(F.col("n_links"), F.col("n_matching"), F.col("n_unique"), link, good & F.col("pattern_ok")),
        issue(F.col("rendered_error").isNotNull(), "rendered-article-link-validation-failed", F.concat(F.lit("the session failed: "), F.col("rendered_error")), link),
        issue(F.col("container_chars") == 0, "container-selector-empty-content", "the container has no text", container),
    ]
    later = [
        issue(by_selector & content.isNull(), "missing-content-selector", "extraction by selector names no selector"),
        issue(by_selector & (F.col("content") == "invalid"), "invalid-content-selector", F.concat(F.lit("not a selector: "), content), content),
        issue(by_selector & F.col("content").isin("missing", "found") & (F.col("content_chars") < schemas.CONTENT_CHARS), "content-selector-not-plausible", F.concat(F.col("content_chars").cast("string"), F.lit(f" characters of content, {schemas.CONTENT_CHARS} are needed")), content),
        issue(needs & paging["selector"].isNull(), "missing-pagination-selector", F.concat(paging["method"], F.lit(" names neither selector nor template"))),
        issue(needs & (F.col("paging") == "invalid"), "invalid-pagination-selector", F.concat(F.lit("not a selector: "), paging["selector"]), paging["selector"]),
        issue(needs & (F.col("paging") == "missing") & ~F.col("text_found"), "pagination-selector-empty", "no such control", paging["selector"]),
    ]
    given = lambda some: F.array_compact(F.array(*some))
    # Invalid exclusions are told when the regions are removed and once more when they are checked.
    issues = F.concat(bad, given(rules), bad, given(later)).cast(schemas.ISSUES)
    out = facts.withColumn("issues", issues)
    return out.select(*keep, is_valid(F.col("issues")).alias("valid"), "issues", F.when(good, F.col("n_links")).otherwise(0).alias("link_count"), F.when(good, F.col("n_unique")).otherwise(0).alias("unique_url_count"))
