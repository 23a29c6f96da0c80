"""Specs as JSON: extraction from a reply, parsing, and the schema's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas

# The names of the JSON form, and below the methods, moments and bounds that a spec may hold.
JSON = (
    "id STRING, listing STRUCT<articleLinkSelector:STRING, articleLinkHrefPattern:STRING, containerSelector:STRING, excludeSelectors:ARRAY<STRING>>, "
    "article STRUCT<method:STRING, contentSelector:STRING, metadataSelectors:STRUCT<title:STRING, author:STRING, publishedAt:STRING, tags:STRING>>, "
    "pagination STRUCT<method:STRING, selector:STRING, textPatterns:ARRAY<STRING>, urlTemplate:STRING>, "
    "waitStrategy STRUCT<afterNavigation:STRING, afterLoadMoreMs:DOUBLE, maxWaitMs:DOUBLE>, evidence STRING"
)
_FENCE = r"(?s)```(?:json)?\s*(.*?)\s*```"


def is_json_object(text: Column) -> Column:
    """Strictly one JSON object. Text after an object would be overlooked, but not within the brackets of an array."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    one = F.schema_of_variant(F.try_variant_get(listed, "$[0]", "variant")).startswith("OBJECT") & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.coalesce(one, F.lit(False))


def extract_json(text: Column) -> Column:
    """The JSON object a reply is, or that its first fenced block is; else null."""
    whole = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    fenced = F.regexp_extract(whole, _FENCE, 1)
    return F.when(is_json_object(whole), whole).when((fenced != "") & is_json_object(fenced), fenced)


def extract_error(text: Column) -> Column:
    whole = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(F.regexp_extract(whole, _FENCE, 1) == "", F.lit("response was not valid JSON")).otherwise("response JSON fence could not be parsed")


def _wanted(value: Column, where: str) -> Column:
    return F.when(value.isNull() | (value == ""), F.lit(f"{where}: expected a non-empty string"))


def _filled(value: Column, where: str) -> Column:
    return F.when(value == "", F.lit(f"{where}: expected a non-empty string"))


def _one_of(value: Column, where: str, *allowed: str) -> Column:
    return F.when(value.isNull() | ~value.isin(*allowed), F.lit(f"{where}: expected one of {', '.join(allowed)}"))


def _whole_number(value: Column, where: str, least: int, most: int) -> Column:
    return F.when(value.isNull() | (value != F.floor(value)) | (value < least) | (value > most), F.lit(f"{where}: expected an integer from {least} to {most}"))


def schema_problems(p: Column) -> Column:
    """What is wrong with a parsed spec, as an array of texts."""
    listing, article, paging, wait = p["listing"], p["article"], p["pagination"], p["waitStrategy"]
    meta = article["metadataSelectors"]
    listed = lambda values, where: F.when(F.exists(values, lambda v: v.isNull() | (v == "")), F.lit(f"{where}: expected non-empty strings"))
    checks = [
        _wanted(listing["articleLinkSelector"], "listing.articleLinkSelector"),
        _wanted(listing["articleLinkHrefPattern"], "listing.articleLinkHrefPattern"),
        _filled(listing["containerSelector"], "listing.containerSelector"),
        listed(listing["excludeSelectors"], "listing.excludeSelectors"),
        _one_of(article["method"], "article.method", "readability", "selector"),
        _filled(article["contentSelector"], "article.contentSelector"),
        *[_filled(meta[k], f"article.metadataSelectors.{k}") for k in ("title", "author", "publishedAt", "tags")],
        F.when((article["method"] == "selector") & article["contentSelector"].isNull(), F.lit("article.contentSelector: contentSelector is required when article.method is selector")),
        _one_of(paging["method"], "pagination.method", "none", "scroll", "button-click", "next-url", "auto"),
        _filled(paging["selector"], "pagination.selector"),
        listed(paging["textPatterns"], "pagination.textPatterns"),
        _filled(paging["urlTemplate"], "pagination.urlTemplate"),
        F.when((paging["method"] == "button-click") & paging["selector"].isNull() & (F.coalesce(F.size(paging["textPatterns"]), F.lit(0)) < 1), F.lit("pagination.selector: button-click pagination requires selector or textPatterns")),
        F.when((paging["method"] == "next-url") & paging["selector"].isNull() & paging["urlTemplate"].isNull(), F.lit("pagination.selector: next-url pagination requires selector or urlTemplate")),
        F.when(wait.isNotNull(), _one_of(wait["afterNavigation"], "waitStrategy.afterNavigation", "networkidle", "load", "domcontentloaded")),
        F.when(wait.isNotNull(), _whole_number(wait["afterLoadMoreMs"], "waitStrategy.afterLoadMoreMs", 0, 30000)),
        F.when(wait.isNotNull(), _whole_number(wait["maxWaitMs"], "waitStrategy.maxWaitMs", 1000, 180000)),
        _wanted(p["evidence"], "evidence"),
    ]
    return F.array_compact(F.array(*checks))


def to_spec(p: Column) -> Column:
    """A parsed spec with the engine's names."""
    l, a, g, w = p["listing"], p["article"], p["pagination"], p["waitStrategy"]
    m = a["metadataSelectors"]
    return F.struct(
        p["id"].alias("id"),
        F.struct(l["articleLinkSelector"].alias("article_link_selector"), l["articleLinkHrefPattern"].alias("article_link_href_pattern"), l["containerSelector"].alias("container_selector"), l["excludeSelectors"].alias("exclude_selectors")).alias("listing"),
        F.struct(a["method"].alias("method"), a["contentSelector"].alias("content_selector"), F.when(m.isNotNull(), F.struct(m["title"].alias("title"), m["author"].alias("author"), m["publishedAt"].alias("published_at"), m["tags"].alias("tags"))).alias("metadata_selectors")).alias("article"),
        F.struct(g["method"].alias("method"), g["selector"].alias("selector"), g["textPatterns"].alias("text_patterns"), g["urlTemplate"].alias("url_template")).alias("pagination"),
        F.when(w.isNotNull(), F.struct(w["afterNavigation"].alias("after_navigation"), w["afterLoadMoreMs"].cast("int").alias("after_load_more_ms"), w["maxWaitMs"].cast("int").alias("max_wait_ms"))).alias("wait_strategy"),
        p["evidence"].alias("evidence"),
    ).cast(schemas.SPEC)


def to_json(spec: Column) -> Column:
    """A spec in its JSON form; absent fields are left out."""
    l, a, g, w = spec["listing"], spec["article"], spec["pagination"], spec["wait_strategy"]
    m = a["metadata_selectors"]
    return F.to_json(
        F.struct(
            spec["id"].alias("id"),
            F.struct(l["article_link_selector"].alias("articleLinkSelector"), l["article_link_href_pattern"].alias("articleLinkHrefPattern"), l["container_selector"].alias("containerSelector"), l["exclude_selectors"].alias("excludeSelectors")).alias("listing"),
            F.struct(a["method"].alias("method"), a["content_selector"].alias("contentSelector"), F.when(m.isNotNull(), F.struct(m["title"].alias("title"), m["author"].alias("author"), m["published_at"].alias("publishedAt"), m["tags"].alias("tags"))).alias("metadataSelectors")).alias("article"),
            F.struct(g["method"].alias("method"), g["selector"].alias("selector"), g["text_patterns"].alias("textPatterns"), g["url_template"].alias("urlTemplate")).alias("pagination"),
            F.when(w.isNotNull(), F.struct(w["after_navigation"].alias("afterNavigation"), w["after_load_more_ms"].alias("afterLoadMoreMs"), w["max_wait_ms"].alias("maxWaitMs"))).alias("waitStrategy"),
            spec["evidence"].alias("evidence"),
        )
    )


def parse_specs(rows: DataFrame, column: str = "json") -> DataFrame:
    """Adds spec (null if it isn't valid) and spec_error to rows with a text column."""
    json = extract_json(F.col(column))
    parsed = F.from_json(json, JSON, {"mode": "PERMISSIVE"})
    rows = rows.withColumns({"_parsed": F.when(json.isNotNull(), parsed)})
    problems = F.when(F.col("_parsed").isNotNull(), schema_problems(F.col("_parsed")))
    error = F.when(F.col(column).isNull(), F.lit("response was empty")).when(F.col("_parsed").isNull(), extract_error(F.col(column))).when(F.size(problems) > 0, F.array_join(problems, "; "))
    rows = rows.withColumn("spec_error", error)
    return rows.withColumn("spec", F.when(F.col("spec_error").isNull(), to_spec(F.col("_parsed")))).drop("_parsed")
