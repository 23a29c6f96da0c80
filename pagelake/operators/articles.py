"""Articles: extraction to Markdown, outcomes, file names and front matter, and the sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..dom import kernels
from ..sources.pages import of_pages, per_page

NAME_LENGTH = 100


def extract(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """pages(page_id, final_url, html[, spec, title_hint]) -> `keep` and article; one parse per page, failures are values."""
    keep = keep or ["page_id", "final_url"]
    inputs = [c for c in ("final_url", "html", "spec", "title_hint") if c in pages.columns]
    nothing = dict.fromkeys(("title", "author", "published_at", "tags", "body_html", "markdown", "excerpt"))
    failed = lambda r, error: {"article": nothing | {"error": f"{type(error).__name__}: {error}"}}
    return per_page(pages, keep, lambda r: {"article": kernels.article(r["html"], r["final_url"], r.get("spec"), r.get("title_hint"))}, f"article {kernels.ARTICLE}", inputs, failed)


def fetched(refs: DataFrame, pages: DataFrame, least_status: int | None = None) -> DataFrame:
    """refs(listing_id, pos, url, title_hint, spec) with the page at each URL; without one, html is null.

    least_status: pages with this status or a higher one count as missing (by default none do)."""
    from ..functions.urls import normalize_loose

    own = pages if least_status is None else pages.where(F.col("status") < least_status)
    # Only keys meet; the HTML of the pages that are asked for comes last.
    places = own.select(normalize_loose(F.col("final_url")).alias("url"), "page_id").join(refs.select("url").distinct(), "url", "left_semi").groupBy("url").agg(F.min("page_id").alias("page_id"))
    found = of_pages(places, own, "url")
    return refs.join(found, "url", "left")


def outcomes(articles: DataFrame) -> DataFrame:
    """Rows with url and article (null: the page wasn't found) -> status saved or failed, and error."""
    error = F.when(F.col("article").isNull(), F.concat(F.lit("no page at "), F.col("url"))).otherwise(F.col("article.error"))
    return articles.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), "saved").otherwise("failed"))


def summary(outcomes_: DataFrame) -> DataFrame:
    """One row: succeeded, failed, errors in order of pos; zeros for no rows."""
    errors = F.sort_array(F.collect_list(F.when(F.col("status") == "failed", F.struct("pos", "url", "error"))))
    return outcomes_.agg(F.count_if(F.col("status") == "saved").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"), F.transform(errors, lambda e: F.struct(e["url"].alias("url"), e["error"].alias("error"))).alias("errors"))


def file_base(title: Column) -> Column:
    """A title as a file name: no path characters, white space as _, at most 100 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(title, r'[\\/:*?"<>|]', ""), r"(?U)\s+", "_"), 1, NAME_LENGTH)


def unique_names(rows: DataFrame, order: list[str], base: str = "base", existing: DataFrame | None = None) -> DataFrame:
    """Adds filename: base.md, and base-2.md, base-3.md ... for later rows of a base in the given order, without clashes.

    A base that itself looks like a numbered name is given way to: numbers that such rows or existing(filename) hold are
    left out. Deterministic, and free of races. Per base, only its own numbers meet."""
    nth = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    ranked = rows.withColumn("_nth", nth)
    plain = ranked.where("_nth = 1").select(F.concat(F.col(base), F.lit(".md")).alias("_name"))
    taken = plain.where(F.col("_name").rlike(r"-[0-9]+\.md$"))
    if existing is not None:
        taken = taken.unionByName(existing.select(F.col("filename").alias("_name")))
        firsts = ranked.join(existing.select(F.col("filename").alias("_name")).distinct().withColumn("_used", F.lit(True)), F.col("_name") == F.concat(F.col(base), F.lit(".md")), "left").drop("_name")
    else:
        firsts = ranked.withColumn("_used", F.lit(None).cast("boolean"))
    # The numbers of each base that are in use, and the free ones in turn.
    split = taken.select(F.regexp_extract("_name", r"^(.*)-([0-9]+)\.md$", 1).alias("_base"), F.regexp_extract("_name", r"^(.*)-([0-9]+)\.md$", 2).try_cast("int").alias("_number")).where("_number >= 2")
    numbers = split.groupBy("_base").agg(F.collect_set("_number").alias("_numbers"))
    firsts = firsts.join(numbers, F.col("_base") == F.col(base), "left")
    used = F.coalesce("_numbers", F.array().cast("array<int>"))
    whole = F.count("*").over(Window.partitionBy(base))
    # Where the plain name is in use, all rows of the base are numbered.
    at = F.col("_nth") - F.when(F.coalesce("_used", F.lit(False)), 0).otherwise(1)
    free = F.array_except(F.sequence(F.lit(2), (whole + F.size(used) + 2).cast("int")), used)
    name = F.when(at == 0, F.concat(F.col(base), F.lit(".md"))).otherwise(F.concat(F.col(base), F.lit("-"), F.when(F.size(used) == 0, at + 1).otherwise(F.try_element_at(free, at.cast("int"))).cast("string"), F.lit(".md")))
    return firsts.withColumn("_whole", whole).withColumn("filename", name).drop("_nth", "_used", "_base", "_numbers", "_whole")


def frontmatter(title: Column, url: Column, date: Column, author: Column, tags: Column) -> Column:
    """The head of a file; absent fields drop out. Only quotes in the title are escaped."""
    given = lambda c, name: F.when(c != "", F.concat(F.lit(f"{name}: "), c))
    listed = F.when(F.size(tags) > 0, F.concat(F.lit("tags: ["), F.array_join(tags, ", "), F.lit("]")))
    return F.concat_ws("\n", F.lit("---"), F.concat(F.lit('title: "'), F.replace(title, F.lit('"'), F.lit('\\"')), F.lit('"')), given(date, "date"), F.concat(F.lit("source: "), url), given(author, "author"), listed, F.lit("---"))


def files(saved: DataFrame, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Saved rows (url, article) -> with filename and content."""
    a = F.col("article")
    rows = saved.withColumn("base", file_base(a["title"]))
    content = F.concat(frontmatter(a["title"], F.col("url"), a["published_at"], a["author"], a["tags"]), F.lit("\n\n# "), a["title"], F.lit("\n\n"), a["markdown"], F.lit("\n"))
    return unique_names(rows, order, "base", existing).withColumn("content", content).drop("base")


def write_table(made: DataFrame, path: str) -> None:
    """filename, content as Parquet: the sink for many articles."""
    made.select("filename", "url", "content").write.mode("append").parquet(path)


def write_files(made: DataFrame, path: str) -> int:
    """One file per article under a path that all executors share; gives their number. A file appears by a rename, so a retried task leaves whole files."""
    from pathlib import Path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Path(path)
        folder.mkdir(parents=True, exist_ok=True)
        for batch in batches:
            for name, content in zip(batch["filename"].to_pylist(), batch["content"].to_pylist()):
                part = folder / f".{name}.part"
                part.write_text(content, encoding="utf-8")
                part.rename(folder / name)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    done = made.select("filename", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0]
    return done or 0


__all__ = ["extract", "fetched", "file_base", "files", "frontmatter", "outcomes", "summary", "unique_names", "write_files", "write_table"]
