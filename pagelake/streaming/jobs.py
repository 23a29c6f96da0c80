"""Streaming forms: article extraction over arriving pages, distinct links, and the life of cache entries.

State grows with the number of distinct keys within the watermark only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import articles, cache
from ..sources import pages as sources


def article_stream(pages: DataFrame, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """A stream of pages -> each URL's article once. With an event-time column, a URL is remembered for the delay; else for good."""
    ready = pages if time is None else pages.withWatermark(time, delay)
    fresh = ready.dropDuplicatesWithinWatermark(["final_url"]) if time else ready.dropDuplicates(["final_url"])
    return articles.extract(fresh.select("page_id", "final_url", "html"))


def link_stream(pages: DataFrame) -> DataFrame:
    """A stream of listing pages -> distinct (page_id, url) of their links."""
    return sources.links(pages).where("resolved IS NOT NULL").select("page_id", F.col("resolved").alias("url")).dropDuplicates(["page_id", "url"])


def cache_stream(results: DataFrame, path: str, as_of: Column, checkpoint: str) -> StreamingQuery:
    """A stream of lookups (cache_key, reason) kept up in the cache table at a path, generation by generation.

    A batch writes the generation of its number, from that of the one before, so a replayed batch writes the same."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/generation={number - 1}" if number else f"{path}/base"
        moved = cache.after_lookup(spark.read.parquet(before), batch, as_of)
        moved.write.mode("overwrite").parquet(f"{path}/generation={number}")

    return results.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
