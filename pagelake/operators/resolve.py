"""The cascade that finds a spec for each listing page: cached, by heuristics, from a provider, or a reason why none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..sources import pages as sources
from . import cache as caches
from . import listing, snapshot, specs, validate
from .lineage import checkpoint

_CANDIDATES = ["article_links", "pagination"]


def resolve(pages: DataFrame, cache: DataFrame, as_of: Column, refresh: bool = False, provider: Callable[[str], str] | None = None, max_retries: int = 2, least: float = schemas.CONFIDENCE) -> DataFrame:
    """page_id, final_url, cache_key, reason (of the cache), source (cache, heuristic, provider or null), spec, valid, confidence, issues, candidates, explanation, error.

    Only pages that a stage left open reach the next one, and HTML is taken only to where it is parsed."""
    looked = checkpoint(caches.lookup(pages, cache, as_of, refresh))
    hit = F.col("reason") == "hit"
    note = F.concat(F.lit("cache: "), F.col("reason"), F.coalesce(F.concat(F.lit(", "), F.col("message")), F.lit("")))
    trace = F.array_compact(F.array(note, F.when(hit, F.concat(F.lit("  key "), F.col("cache_key"), F.lit(", "), F.col("unique_url_count").cast("string"), F.lit(" URLs fit")))))
    looked = looked.select("page_id", "cache_key", "reason", F.col("spec").alias("cached"), F.col("issues").alias("cache_issues"), trace.alias("trace"))
    rows = checkpoint(pages.select("page_id", "final_url").join(looked, "page_id"))
    open_ = rows.where("cached IS NULL").select("page_id", "final_url")

    analyzed = checkpoint(listing.analyze(sources.listing_facts(sources.of_pages(open_, pages, "page_id", "final_url"))))
    guessed = sources.of_pages(open_.join(analyzed.where("spec IS NOT NULL").select("page_id", "spec"), "page_id"), pages, "page_id", "final_url", "spec")
    checked = checkpoint(validate.validate(guessed))
    made = analyzed.join(checked, "page_id", "left")
    good = F.coalesce(F.col("valid") & (F.col("confidence") >= least), F.lit(False))
    told = F.when(
        F.col("error").isNull(),
        F.array_compact(
            F.array(
                F.concat(F.lit("counting: confidence "), F.format_string("%.2f", "confidence"), F.lit(", "), F.size("article_links").cast("string"), F.lit(" link patterns, "), F.size("pagination").cast("string"), F.lit(" signs of pagination")),
                F.when(~F.col("valid"), F.concat(F.lit("  the spec fails: "), F.array_join(F.transform("issues", lambda i: i["code"]), ", "))),
            )
        ),
    ).otherwise(F.array(F.concat(F.lit("counting: "), F.col("error"))))
    made = made.select("page_id", F.when(good, F.col("spec")).alias("guess"), F.when(good, F.col("confidence")).alias("confidence"), "issues", *_CANDIDATES, told.alias("told"))
    out = rows.join(made, "page_id", "left")
    source = F.when(F.col("cached").isNotNull(), "cache").when(F.col("guess").isNotNull(), "heuristic")
    out = out.withColumns({"source": source, "spec": F.coalesce("cached", "guess"), "issues": F.when(F.col("cached").isNotNull(), F.col("cache_issues")).otherwise(F.col("issues")), "explanation": F.concat("trace", F.coalesce("told", F.array().cast("array<string>")))})
    out = checkpoint(out.withColumn("error", F.when(F.col("spec").isNull(), F.lit("counting gave no spec that holds, and there is no provider"))))
    if provider is not None:
        left = out.where("spec IS NULL")
        asked = ask(sources.of_pages(left, pages, "page_id", "final_url", *_CANDIDATES), provider, max_retries)
        out = out.join(asked, "page_id", "left").withColumns({
            "source": F.when(F.col("asked_spec").isNotNull(), F.lit("provider")).otherwise(F.col("source")), "spec": F.coalesce("spec", "asked_spec"),
            "explanation": F.concat("explanation", F.coalesce("asked_trace", F.array().cast("array<string>"))), "error": F.coalesce("asked_error", F.when(F.col("spec").isNull() & F.col("asked_spec").isNull(), F.col("error"))),
        })
        out = out.withColumn("error", F.when(F.col("spec").isNull(), F.col("error")))
    return out.select("page_id", "final_url", "cache_key", "reason", "source", "spec", F.col("spec").isNotNull().alias("valid"), "confidence", "issues", *_CANDIDATES, "explanation", "error")


def ask(rows: DataFrame, provider: Callable[[str], str], max_retries: int = 2) -> DataFrame:
    """rows(page_id, final_url, html, candidates) -> page_id, asked_spec, asked_trace, asked_error, attempts.

    The provider is called on the executors, once per page and attempt, with a prompt that on a retry holds the last
    reply and what was wrong with it. An attempt is a stage over the pages still open; there are few attempts."""
    from ..sources.pages import per_page

    prompts = snapshot.prompts(rows)
    state = prompts.select("page_id", "final_url", "html", "prompt", F.lit(None).cast("string").alias("reply"), F.lit(None).cast("string").alias("last_error"), F.array(F.lit("provider:")).alias("trace"), F.lit(None).cast("array<struct<severity:string,code:string,message:string,selector:string>>").alias("last_issues"))
    done = None
    for attempt in range(max_retries + 1):
        text = F.col("prompt") if attempt == 0 else snapshot.retry_prompt(F.col("prompt"), F.col("reply"), F.col("last_error"), F.col("last_issues"))

        def call(row: dict) -> dict:
            try:
                return {"answer": provider(row["sent"])}
            except Exception as error:  # noqa: BLE001  a failed call is an attempt without reply
                return {"answer": f"error: {error}"}

        sent = state.withColumn("sent", text)
        replied = per_page(sent, ["page_id", "final_url", "html", "prompt", "trace"], call, "answer STRING", ["sent"])
        # A reply must not be asked for twice, so the stage's result is kept.
        replied = checkpoint(replied)
        parsed = specs.parse_specs(replied, "answer")
        checked = validate.validate(parsed.where("spec IS NOT NULL").select("page_id", "final_url", "html", "spec"))
        tried = parsed.join(checked, "page_id", "left")
        told = F.array_join(F.transform("issues", lambda i: F.concat(i["code"], F.lit(": "), i["message"])), "; ")
        problem = F.when(F.col("spec_error").isNotNull(), F.col("spec_error")).when(~F.col("valid"), told)
        kind = F.when(F.col("spec_error").startswith("response"), "  unreadable: ").when(F.col("spec_error").isNotNull(), "  not a spec: ").otherwise("  fails on the page: ")
        line = F.when(problem.isNull(), F.concat(F.lit("  holds: "), F.col("unique_url_count").cast("string"), F.lit(" URLs fit"))).otherwise(F.concat(kind, problem))
        tried = checkpoint(tried.select("page_id", "final_url", "html", "prompt", F.col("answer").alias("reply"), problem.alias("last_error"), F.concat("trace", F.array(F.lit(f"asked, {attempt + 1}"), line)).alias("trace"), F.col("issues").alias("last_issues"), F.when(problem.isNull(), F.col("spec")).alias("asked_spec")))
        finished = tried.where("asked_spec IS NOT NULL") if attempt < max_retries else tried
        failed = F.concat(F.lit(f"none of {max_retries + 1} replies can be used; the last: "), F.col("last_error"))
        part = finished.select("page_id", "asked_spec", F.col("trace").alias("asked_trace"), F.when(F.col("asked_spec").isNull(), failed).alias("asked_error"), F.lit(attempt + 1).alias("attempts"))
        done = part if done is None else done.unionByName(part)
        state = tried.where("asked_spec IS NULL").drop("asked_spec")
        if attempt < max_retries and state.isEmpty():
            break
    return done
