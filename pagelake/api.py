"""The engine's two commands, inspect and download, over tables of pages."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import schemas
from .operators import articles, cache, collect, resolve, validate
from .operators.lineage import checkpoint
from .operators.rendered import Opener
from .sources.pages import of_pages


def positive(name: str, value: int | None) -> int | None:
    if value is not None and (isinstance(value, bool) or int(value) != value or value <= 0):
        raise ValueError(f"{name} must be a positive integer")
    return value


@dataclass
class Inspection:
    """resolution: how each page's spec was found; preview: the first links that it gives."""

    resolution: DataFrame
    preview: DataFrame


@dataclass
class Download:
    """files: filename, url, content; outcomes: one row per article; summary: one row."""

    files: DataFrame
    outcomes: DataFrame
    summary: DataFrame
    collection: DataFrame | None = None
    resolution: DataFrame | None = None
    #: The cache after the run: hits and failures counted, new specs saved.
    entries: DataFrame | None = None


def _listings(listings: DataFrame, resolution: DataFrame) -> DataFrame:
    return of_pages(resolution.where("spec IS NOT NULL").withColumn("listing_id", F.col("page_id")), listings, "listing_id", "final_url", "spec")


def inspect(listings: DataFrame, pages: DataFrame | None = None, entries: DataFrame | None = None, as_of: Column | None = None, refresh: bool = False, provider: Callable[[str], str] | None = None, spec: DataFrame | None = None, open_session: Opener | None = None) -> Inspection:
    """How listing pages resolve, and a preview of three steps, 15 seconds and ten links. spec(json): one spec that is tried on all of them instead.

    open_session: gives a session on a rendered page, in which a given spec is validated and the preview is collected."""
    as_of = as_of if as_of is not None else F.current_timestamp()
    entries = entries if entries is not None else cache.empty(listings.sparkSession)
    if spec is not None:
        from .operators import specs

        given = specs.parse_specs(spec).select("spec", "spec_error")
        if given.limit(2).count() != 1:
            raise ValueError("spec must have one row")
        applied = listings.join(F.broadcast(given), how="inner", on=F.lit(True))
        checked = validate.validate(applied.where("spec IS NOT NULL").select("page_id", "final_url", "html", "spec"), open_session=open_session)
        resolution = applied.select("page_id", "final_url", "spec", "spec_error").join(checked, "page_id", "left")
        resolution = resolution.select("page_id", "final_url", F.lit("given").alias("source"), F.when(F.col("valid"), F.col("spec")).alias("spec"), F.coalesce("valid", F.lit(False)).alias("valid"), "issues", F.col("spec_error").alias("error"))
    else:
        resolution = resolve.resolve(listings, entries, as_of, refresh, provider)
    resolution = checkpoint(resolution)
    preview = collect.collect(_listings(listings, resolution), pages if pages is not None else listings, schemas.PREVIEW_LIMIT, schemas.PREVIEW_ITERATIONS, schemas.PREVIEW_SECONDS if open_session is not None else None, open_session)
    return Inspection(resolution, preview)


def extract_articles(pages: DataFrame) -> Download:
    """Each page as an article by itself, without a listing."""
    made = articles.extract(pages.select("page_id", "final_url", "html", F.col("final_url").alias("url")), ["page_id", "url"])
    # Names need all titles before the first file; the pages are parsed once for both.
    done = checkpoint(articles.outcomes(made).withColumn("pos", F.col("page_id")))
    files = articles.files(done.where("status = 'saved'"), ["page_id"])
    return Download(files, done, articles.summary(done))


def download(listings: DataFrame, pages: DataFrame, entries: DataFrame | None = None, as_of: Column | None = None, limit: int | None = None, max_iterations: int = schemas.MAX_ITERATIONS, refresh: bool = False, provider: Callable[[str], str] | None = None, current_page: bool = False, least_status: int | None = None, cache_path: str | None = None, open_session: Opener | None = None, max_seconds: float | None = None) -> Download:
    """Articles of listing pages: resolve, collect links, fetch their pages from the table, extract, name and render.

    A listing that doesn't resolve is taken as an article itself. cache_path: a folder of cache generations that entries
    are read from, unless given, and that the renewed ones are written to; so a second run resolves from the cache.
    open_session: gives a session on a rendered page, in which links are collected; max_seconds: see collect.collect."""
    positive("limit", limit)
    positive("max_iterations", max_iterations)
    if current_page:
        if limit is not None or refresh:
            warnings.warn("limit and refresh are ignored when the current page is taken", stacklevel=2)
        return extract_articles(listings)
    limit = limit or schemas.DEFAULT_LIMIT
    as_of = as_of if as_of is not None else F.current_timestamp()
    spark = listings.sparkSession
    if entries is None:
        entries = cache.load(spark, cache_path) if cache_path else cache.empty(spark)
    resolution = checkpoint(resolve.resolve(listings, entries, as_of, refresh, provider))
    entries = checkpoint(cache.renewed(entries, resolution, as_of))
    if cache_path:
        cache.store(entries, cache_path)
    own = _listings(listings, resolution)
    collection = checkpoint(collect.collect(own, pages, limit, max_iterations, max_seconds, open_session))
    refs = collection.select("listing_id", F.posexplode("links").alias("pos", "link")).select("listing_id", F.col("pos").cast("long").alias("pos"), "link.url", "link.title_hint")
    refs = refs.join(resolution.select(F.col("page_id").alias("listing_id"), "spec"), "listing_id")
    found = articles.fetched(refs, pages, least_status)
    made = articles.extract(found.where("html IS NOT NULL").withColumn("final_url", F.col("url")), ["listing_id", "pos", "url"])
    missing = found.where("html IS NULL").select("listing_id", "pos", "url").withColumn("article", F.lit(None).cast(made.schema["article"].dataType))
    alone = resolution.where("spec IS NULL").select("page_id", F.col("page_id").alias("listing_id"), F.lit(0).cast("long").alias("pos"), F.col("final_url").alias("url"), "final_url")
    alone = of_pages(alone, listings, "listing_id", "pos", "url", "final_url")
    fallback = articles.extract(alone, ["listing_id", "pos", "url"])
    done = checkpoint(articles.outcomes(made.unionByName(missing).unionByName(fallback)))
    files = articles.files(done.where("status = 'saved'"), ["listing_id", "pos"])
    return Download(files, done, articles.summary(done), collection, resolution, entries)


def exit_code(run: Download) -> int:
    """What a command around download ends with: 1 if any article failed, else 0."""
    return int(run.summary.first()["failed"] > 0)
