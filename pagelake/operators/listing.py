"""Listing analysis: repeated links as clusters by path pattern, pagination signals, and the spec they give.

Links are grouped by (page, pattern). A group's common container is the common prefix of the smallest and the largest of
its links' ancestor paths: min and max are enough, so no tree is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..functions import urls
from .lineage import checkpoint


def page_links(facts: DataFrame) -> DataFrame:
    """One row per visible link with a strictly normalized URL."""
    rows = facts.select("page_id", "final_url", F.posexplode("links").alias("pos", "link")).select("page_id", "final_url", "pos", "link.*")
    refused = F.col("href").rlike("^(#|mailto:|tel:)") | (F.col("href") == "")
    strict = urls.normalize_strict(F.col("url"), F.col("final_url"))
    return rows.where("visible").where(~refused).withColumn("url", strict).where("url IS NOT NULL")


def link_score(pattern: Column, unique: Column, total: Column, in_main: Column) -> Column:
    depth = F.size(urls.segments(pattern))
    return F.least(F.least(unique / 10, F.lit(0.45)) + F.least(unique / F.greatest(total, F.lit(1)), F.lit(0.3)) + F.least(depth / 8, F.lit(0.15)) + F.when(in_main, 0.1).otherwise(0.0), F.lit(0.98))


def overall_score(link: Column, pagination: Column) -> Column:
    boost = F.when(pagination.isNotNull(), F.least(pagination * 0.15, F.lit(0.15))).otherwise(0.0)  # least() passes over null
    return F.least(link + boost, F.lit(0.98))


def link_candidates(facts: DataFrame, top: int = schemas.TOP_CANDIDATES) -> DataFrame:
    """page_id, rank, selector, href_pattern, count, score, container_selector, evidence: the best clusters of each page."""
    found = page_links(facts)
    total = F.count("*").over(Window.partitionBy("page_id"))
    found = found.withColumns({"total": total, "pattern": urls.path_pattern(urls.path(F.col("url")))}).where("pattern IS NOT NULL")
    groups = found.groupBy("page_id", "pattern").agg(F.countDistinct("url").alias("count"), F.first("total").alias("total"), F.min("pos").alias("first_pos"), F.min("path").alias("low"), F.max("path").alias("high"))
    groups = groups.where(F.col("count") >= schemas.MIN_CLUSTER)
    common = F.filter(F.zip_with("low", "high", lambda a, b: F.when(a["id"] == b["id"], a)), lambda x: x.isNotNull())
    groups = groups.withColumn("common", common).withColumn("container", F.try_element_at("common", F.lit(-1)))
    score = link_score(F.col("pattern"), F.col("count"), F.col("total"), F.exists("common", lambda n: n["tag"] == "main"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), F.desc("count"), "first_pos"))
    ranked = groups.withColumn("score", score).withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select(
        "page_id", "rank", urls.pattern_selector(F.col("pattern")).alias("selector"), urls.pattern_regex(F.col("pattern")).alias("href_pattern"), F.col("count").cast("int").alias("count"), "score",
        F.when(F.col("container.tag") != "body", F.col("container.selector")).alias("container_selector"),
        F.concat(F.col("count").cast("string"), F.lit(" different links fit "), F.col("pattern")).alias("evidence"),
        urls.last_static(F.col("pattern")).alias("static"),
    )


def has_control(facts_links: Column, controls: Column, static: Column) -> Column:
    """Whether a control stands beside at least three article links: any visible one that isn't inside such a link."""
    fits = lambda href: static.isNull() | F.contains(href, F.concat(F.lit("/"), static, F.lit("/")))
    articles = F.filter(facts_links, lambda x: x["visible"] & fits(x["href"]))
    return (F.size(articles) >= schemas.MIN_CLUSTER) & F.exists(controls, lambda c: ~F.exists(c["hrefs"], fits))


_SIGNAL = "struct<method:string,score:double,selector:string,text_patterns:array<string>,url_template:string,evidence:string>"


def pagination_candidates(facts: DataFrame, candidates: DataFrame, top: int = schemas.TOP_CANDIDATES) -> DataFrame:
    """page_id, rank, method, score, selector, text_patterns, url_template, evidence: five signals, the best first."""
    best = candidates.where("rank = 1").select("page_id", "static", F.lit(True).alias("listed"))
    rows = facts.join(best, "page_id", "left")
    none = F.lit(None).cast("string")

    def signal(when: Column, method: str, score: float, evidence: str, selector: Column = none, template: Column = none) -> Column:
        made = F.struct(F.lit(method).alias("method"), F.lit(score).alias("score"), selector.alias("selector"), F.lit(None).cast("array<string>").alias("text_patterns"), template.alias("url_template"), F.lit(evidence).alias("evidence"))
        return F.when(F.coalesce(when, F.lit(False)), made)

    url = F.col("final_url")
    signals = F.array(
        signal(F.col("rel_next").isNotNull(), "next-url", 0.95, 'a link marked rel=next', F.col("rel_next")),
        signal(F.col("listed") & has_control(F.col("links"), F.col("controls"), F.col("static")), "auto", 0.82, "a control beside the article links"),
        signal(urls.has_page_param(url), "next-url", 0.65, "a page number in the URL's query", template=urls.page_template(url)),
        signal(F.col("region").isNotNull(), "next-url", 0.6, "a region named for pagination", F.col("region")),
        signal(F.col("feed"), "auto", 0.45, "marks of a feed"),
    )
    each = rows.select("page_id", F.posexplode(F.filter(signals, lambda s: s.isNotNull())).alias("order", "s")).select("page_id", "order", "s.*")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "order"))
    return each.withColumn("rank", rank).where(F.col("rank") <= top).drop("order")


def analyze(facts: DataFrame) -> DataFrame:
    """page_id, spec, confidence, evidence, candidates and error (no repeated links) of each page."""
    facts = checkpoint(facts)  # read several times below, but parsed once
    found = checkpoint(link_candidates(facts))
    paging = pagination_candidates(facts, found)
    listed = lambda df, cols, name: df.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("rank", *cols))).alias(name))
    article_links = listed(found, ["selector", "href_pattern", "count", "score", "container_selector", "evidence", "static"], "article_links")
    signals = listed(paging, ["method", "score", "selector", "text_patterns", "url_template", "evidence"], "pagination")
    rows = facts.select("page_id", "final_url").join(article_links, "page_id", "left").join(signals, "page_id", "left")
    link, page = F.try_element_at("article_links", F.lit(1)), F.try_element_at("pagination", F.lit(1))
    confidence = F.when(link.isNotNull(), overall_score(link["score"], page["score"]))
    rows = rows.withColumns({"link": link, "page": page, "confidence": confidence})
    shown = F.format_string("%.2f", F.col("confidence"))
    wait = schemas.WAIT
    spec = F.struct(
        F.lit(None).cast("string").alias("id"),
        F.struct(F.col("link.selector").alias("article_link_selector"), F.col("link.href_pattern").alias("article_link_href_pattern"), F.col("link.container_selector").alias("container_selector"), F.array(*map(F.lit, schemas.EXCLUDE_SELECTORS)).alias("exclude_selectors")).alias("listing"),
        F.expr("named_struct('method', 'readability', 'content_selector', cast(null as string), 'metadata_selectors', cast(null as struct<title:string,author:string,published_at:string,tags:string>))").alias("article"),
        F.struct(F.coalesce("page.method", F.lit("none")).alias("method"), F.col("page.selector").alias("selector"), F.col("page.text_patterns").alias("text_patterns"), F.col("page.url_template").alias("url_template")).alias("pagination"),
        F.struct(F.lit(wait[0]).alias("after_navigation"), F.lit(wait[1]).alias("after_load_more_ms"), F.lit(wait[2]).alias("max_wait_ms")).alias("wait_strategy"),
        F.concat(F.lit("by counting: "), F.col("link.count").cast("string"), F.lit(" links of one pattern, confidence "), shown).alias("evidence"),
    )
    evidence = F.array(F.col("link.evidence"), F.coalesce("page.evidence", F.lit("no sign of further pages")), F.concat(F.lit("confidence "), shown))
    return rows.select(
        "page_id", F.when(link.isNotNull(), spec).alias("spec"), "confidence", F.when(link.isNotNull(), evidence).alias("evidence"),
        F.coalesce("article_links", F.expr("array()").cast("array<struct<rank:int,selector:string,href_pattern:string,count:int,score:double,container_selector:string,evidence:string,static:string>>")).alias("article_links"),
        F.coalesce("pagination", F.expr("array()").cast(f"array<struct<rank:int,{_SIGNAL[7:]}>")).alias("pagination"),
        F.when(link.isNull(), F.lit("no links of one pattern")).alias("error"),
    )
