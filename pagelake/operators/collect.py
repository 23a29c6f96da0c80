"""Collection of article links across paginated listings.

Each listing walks its pages by next-page URL. A step is one stage over all walks that still go on: their pages are found
by URL in the table of pages, links are read off, and walks that stop are settled. The walked steps go to the shared
checkpoint folder, so a lost executor costs a reread. The rules for stopping, in their order, are window functions."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..functions import urls
from ..sources import pages as sources
from . import rendered
from .lineage import checkpoint


def next_url(spec: Column, current: Column, next_rel: Column, next_selected: Column) -> Column:
    """The next page: by template, else the page's rel=next, else the spec's selector; only for specs that page by URL."""
    paging = spec["pagination"]
    found = F.when(paging["url_template"].isNotNull(), urls.next_from_template(paging["url_template"], current)).otherwise(F.coalesce(next_rel, F.when(paging["selector"].isNotNull(), next_selected)))
    return F.when(paging["method"] == "next-url", found)


def page_refs(facts: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of spec facts -> `keep` and refs: the page's distinct matching links in order, with their texts."""
    clean = F.filter(F.transform(F.filter("hrefs", lambda h: h["fits"]), lambda h: F.struct(urls.normalize_loose(h["url"]).alias("url"), h["text"].alias("title_hint"))), lambda r: r["url"].isNotNull())
    distinct = F.filter(clean, lambda r, i: F.array_position(F.transform(clean, lambda x: x["url"]), r["url"]) == i + 1)
    return facts.withColumn("refs", F.when(F.col("bad_links"), F.slice(distinct, 1, 0)).otherwise(distinct)).select(*keep, "refs")


def walk(listings: DataFrame, pages: DataFrame, max_iterations: int = schemas.MAX_ITERATIONS, limit: int | None = None, stale: int = schemas.STALE_LIMIT, max_seconds: float | None = None) -> DataFrame:
    """listings(listing_id, final_url, html, spec) -> one row per step: listing_id, iter, url, refs, next_url, html_length, out_of_time, spec.

    A page that isn't in the table of pages, or is the page itself, ends the walk; so does a stopping rule, for which a
    walk carries the URLs it has seen and its counts of steps without progress. max_seconds is a limit on all walks
    together, since they go step by step; by default there is none."""
    began = time.monotonic()
    # Keys of pages by URL, written once; a step looks up its few URLs there and fetches their HTML alone.
    by_url = None
    state = ["seen", "dups", "unchanged", "signature"]
    frontier = listings.select("listing_id", "final_url", "html", "spec", F.array().cast("array<string>").alias("seen"), F.lit(0).alias("dups"), F.lit(0).alias("unchanged"), F.lit("").alias("signature"))
    steps = None
    for i in range(1, max_iterations + 1):
        facts = sources.spec_facts(frontier, ["listing_id", "final_url", "spec", *state])
        step = page_refs(facts, ["listing_id", "final_url", "spec", "next_rel", "next_selected", "html_length", *state])
        step = step.withColumn("next_url", next_url(F.col("spec"), F.col("final_url"), F.col("next_rel"), F.col("next_selected")))
        step = step.withColumn("next_url", F.when(F.col("next_url") != F.col("final_url"), F.col("next_url")))
        step = step.withColumn("fresh", F.array_except(F.transform("refs", lambda r: r["url"]), F.col("seen")))
        step = step.withColumns({"seen": F.concat("seen", "fresh"), "dups": F.when(F.size("fresh") == 0, F.col("dups") + 1).otherwise(0)})
        step = step.withColumn("signed", F.concat_ws(":", "final_url", "html_length", F.size("seen")))
        step = step.withColumns({"unchanged": F.when(F.col("signed") == F.col("signature"), F.col("unchanged") + 1).otherwise(0), "signature": F.col("signed")})
        step = checkpoint(step.select("listing_id", F.lit(i).alias("iter"), F.col("final_url").alias("url"), "refs", "next_url", "html_length", "spec", *state))
        out_of_time = max_seconds is not None and time.monotonic() - began > max_seconds
        told = step.drop(*state).withColumn("out_of_time", F.lit(out_of_time))
        steps = told if steps is None else steps.unionByName(told)
        going = step.where("next_url IS NOT NULL").where((F.col("dups") < stale) & (F.col("unchanged") < stale))
        if limit:
            going = going.where(F.size("seen") < limit)
        if i == max_iterations or out_of_time or going.isEmpty():
            break
        if by_url is None:
            by_url = checkpoint(pages.groupBy(F.col("final_url").alias("next_url")).agg(F.min("page_id").alias("page_id")))
        reached = going.select("listing_id", "next_url", "spec", *state).join(by_url, "next_url").withColumnRenamed("next_url", "final_url")
        frontier = sources.of_pages(reached, pages, "listing_id", "final_url", "spec", *state)
    return steps


def settle(steps: DataFrame, limit: int | None = schemas.DEFAULT_LIMIT, max_iterations: int = schemas.MAX_ITERATIONS, stale: int = schemas.STALE_LIMIT) -> DataFrame:
    """Steps of walk -> listing_id, links (url, title_hint), iterations, stopped_because: the rules for stopping, in order:
    limit, complete (no pagination), duplicates, unchanged-dom, complete (no next page), max-iterations, max-time; a walk
    whose session failed has failed. Steps may lack the columns out_of_time and failed."""
    given = lambda c, kind: F.col(c) if c in steps.columns else F.lit(None).cast(kind)
    refs = steps.select("listing_id", "iter", F.posexplode("refs").alias("pos", "ref")).select("listing_id", "iter", "pos", "ref.*")
    first = Window.partitionBy("listing_id", "url").orderBy("iter", "pos")
    new = refs.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    order = Window.partitionBy("listing_id").orderBy("iter", "pos")
    new = new.withColumn("n", F.row_number().over(order))
    counts = new.groupBy("listing_id", "iter").agg(F.count("*").alias("added"))
    walk_order = Window.partitionBy("listing_id").orderBy("iter")
    rows = steps.select("listing_id", "iter", "url", "next_url", "html_length", F.col("spec.pagination.method").alias("method"), given("out_of_time", "boolean").alias("out_of_time"), given("failed", "string").alias("failed")).join(counts, ["listing_id", "iter"], "left").fillna(0, ["added"])
    so_far = rows.withColumn("total", F.sum("added").over(walk_order))
    signature = F.concat_ws(":", "url", "html_length", "total")
    so_far = so_far.withColumn("same", F.coalesce(signature == F.lag(signature).over(walk_order), F.lit(False)).cast("int"))
    run = lambda flag: F.sum(F.when(flag, 0).otherwise(1)).over(walk_order)
    so_far = so_far.withColumns({"dup_island": run(F.col("added") == 0), "dom_island": run(F.col("same") == 1)})
    inside = lambda c: Window.partitionBy("listing_id", c).orderBy("iter")
    # Steps without progress since the last step with progress.
    so_far = so_far.withColumns({"dups": F.sum(F.when(F.col("added") == 0, 1).otherwise(0)).over(inside("dup_island")), "unchanged": F.sum("same").over(inside("dom_island"))})
    last = F.lead("iter").over(walk_order).isNull()
    reached = F.lit(False) if not limit else F.col("total") >= limit
    stop = (
        F.when(F.col("failed").isNotNull(), "failed")
        .when(reached, "limit")
        .when(F.col("method") == "none", "complete")
        .when(F.col("dups") >= stale, "duplicates")
        .when(F.col("unchanged") >= stale, "unchanged-dom")
        .when(last & F.col("next_url").isNull(), "complete")
        .when(last & (F.col("iter") >= max_iterations), "max-iterations")
        .when(last, F.when(F.col("out_of_time"), "max-time").otherwise("complete"))
    )
    ended = so_far.withColumn("stop", stop).where("stop IS NOT NULL").groupBy("listing_id").agg(F.min(F.struct("iter", "stop")).alias("e")).select("listing_id", F.col("e.iter").alias("iterations"), F.col("e.stop").alias("stopped_because"))
    kept = new.join(ended, "listing_id").where(F.col("iter") <= F.col("iterations"))
    if limit:
        kept = kept.where(F.col("n") <= limit)
    links = kept.groupBy("listing_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "url", "title_hint"))), lambda x: F.struct(x["url"].alias("url"), x["title_hint"].alias("title_hint"))).alias("links"))
    none = F.array().cast("array<struct<url:string,title_hint:string>>")
    return ended.join(links, "listing_id", "left").select("listing_id", F.coalesce("links", none).alias("links"), "iterations", "stopped_because")


def collect(listings: DataFrame, pages: DataFrame | None, limit: int | None = schemas.DEFAULT_LIMIT, max_iterations: int = schemas.MAX_ITERATIONS, max_seconds: float | None = None, open_session: rendered.Opener | None = None) -> DataFrame:
    """listings(listing_id, final_url, html, spec) -> listing_id, links, iterations, stopped_because.

    With open_session, the listings are walked in rendered pages, each for at most max_seconds (300 if none are given);
    else in the table of pages."""
    if open_session is None:
        return settle(walk(listings, pages, max_iterations, limit, max_seconds=max_seconds), limit, max_iterations)
    seconds = schemas.MAX_SECONDS if max_seconds is None else max_seconds
    return settle(checkpoint(rendered.walk(listings, open_session, max_iterations, limit, max_seconds=seconds)), limit, max_iterations)


def new_hrefs(before: Column, after: Column) -> Column:
    """The hrefs that weren't there before; whether a page moved on is whether there are any, or more hrefs than before."""
    return F.array_except(after, before)


def moved_on(before: Column, after: Column) -> Column:
    return (F.size(new_hrefs(before, after)) > 0) | (F.size(after) > F.size(before))


__all__ = ["collect", "moved_on", "new_hrefs", "next_url", "page_refs", "settle", "walk"]
