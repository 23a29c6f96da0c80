"""Pages as relations: from tables, folders of HTML files, single documents or an injected fetcher; and what parsing gives of them.

Parsing is the one step that needs Python. It runs once per page and map-only; HTML is dropped right after it."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import schemas
from ..dom import kernels
from ..functions.urls import needs_rendering
from ..operators.lineage import checkpoint

#: Rows parsed before their facts are sent on.
STEP = 64


def from_table(table: DataFrame, render_mode: str = "auto") -> DataFrame:
    """A table (page_id, url, html[, status, final_url]) as pages."""
    if render_mode not in ("auto", "never", "always"):
        raise ValueError("render mode must be auto, never or always")
    has = lambda name, otherwise: F.col(name) if name in table.columns else otherwise
    return table.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").alias("requested_url"),
        has("final_url", F.col("url")).alias("final_url"),
        has("status", F.lit(200)).cast("int").alias("status"),
        "html",
        F.lit("rendered" if render_mode == "always" else "static").alias("source"),
        F.lit(render_mode).alias("render_mode"),
    )


def from_dir(spark: SparkSession, path: str, base_url: str) -> DataFrame:
    """A folder of .html files; a file's URL is its name under the base."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path)
    url = F.concat(F.lit(base_url.rstrip("/") + "/"), F.element_at(F.split("path", "/"), -1))
    return from_table(files.select(F.abs(F.xxhash64("path")).alias("page_id"), url.alias("url"), F.decode("content", "UTF-8").alias("html")))


def from_html(spark: SparkSession, url: str, html: str) -> DataFrame:
    """One document, such as a browser's active tab: status 200, rendered."""
    return spark.createDataFrame([(0, url, url, 200, html, "rendered", "auto")], schemas.PAGES)


def from_fetcher(urls: DataFrame, fetch: Callable[[str], tuple[str, int, str]], delay: float = 0.0) -> DataFrame:
    """urls(page_id, url) fetched on the executors by fetch(url) -> (final url, status, html); a failure is a row with status 0.

    delay: seconds that a task waits before each page but its first; how many are fetched at once is the number of tasks."""

    schema = to_arrow_schema(StructType.fromDDL(schemas.PAGES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            for row in batch.to_pylist():
                if begun and delay:
                    time.sleep(delay)
                begun = True
                try:
                    final, status, html = fetch(row["url"])
                except Exception as error:  # noqa: BLE001  a page that can't be had is a result
                    final, status, html = row["url"], 0, f"<!-- {error} -->"
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (row["page_id"], row["url"], final, status, html, "static", "never")))], schema)

    return urls.select("page_id", "url").mapInArrow(run, schemas.PAGES)


def render_plan(pages: DataFrame) -> DataFrame:
    """Which pages want a browser: always, or where the mode allows it and the page looks built by scripts."""
    wants = (F.col("render_mode") == "always") | ((F.col("render_mode") != "never") & needs_rendering(F.col("html")))
    return pages.withColumn("render", F.coalesce(wants, F.lit(False)))


def per_page(rows: DataFrame, keep: list[str], kernel: Callable[[dict], list[dict] | dict], added: str, inputs: list[str], failed: Callable[[dict, Exception], list[dict] | dict] | None = None) -> DataFrame:
    """kernel(row of inputs) -> one or many rows with the `added` columns, beside the columns `keep`; map-only.

    failed: what a row gives on which the kernel fails. By default it is taken as a page without HTML, so that no page ends the job."""
    need = list(dict.fromkeys([*keep, *inputs]))
    ready = rows.select(*need)
    schema = StructType([*ready.select(*keep).schema.fields, *StructType.fromDDL(added).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                out = []
                for row in batch.slice(at, STEP).to_pylist():
                    try:
                        made = kernel(row)
                    except Exception as error:  # noqa: BLE001  a page that can't be read is a result
                        made = failed(row, error) if failed is not None else kernel(row | {"html": None})
                    own = {k: row[k] for k in keep}
                    out += [own | m for m in ([made] if isinstance(made, dict) else made)]
                # An element with very many rows is sent on in parts.
                for start in range(0, len(out), 20_000):
                    yield pa.RecordBatch.from_pylist(out[start : start + 20_000], arrow)

    return ready.mapInArrow(run, schema)


#: Rows of keys that are sent to all tasks at most.
FEW = 50_000


def of_pages(keys: DataFrame, pages: DataFrame, *keep: str) -> DataFrame:
    """keys(page_id, ...) -> the columns `keep` with the html of each page.

    The keys are written first and counted: few ones go to where the pages are, so that no HTML moves; more are joined."""
    keys = checkpoint(keys.select(*dict.fromkeys(["page_id", *keep])))
    few = keys.limit(FEW + 1).count() <= FEW
    return pages.select("page_id", "html").join(F.broadcast(keys) if few else keys, "page_id").select(*keep, "html")


def dom_nodes(pages: DataFrame) -> DataFrame:
    """The relation of all elements of all pages."""
    added = schemas.NODES.split(", ", 1)[1]
    return per_page(pages, ["page_id"], lambda r: [n | {"attrs": list(n["attrs"].items())} for n in kernels.dom_nodes(r["html"])], added, ["html"])


def listing_facts(pages: DataFrame) -> DataFrame:
    """page_id, final_url and what listing analysis needs of a page."""
    return per_page(pages, ["page_id", "final_url"], lambda r: kernels.listing_facts(r["html"], r["final_url"]), kernels.FACTS, ["html"])


def spec_facts(pages: DataFrame, keep: list[str]) -> DataFrame:
    """pages(final_url, html, spec) -> what the spec's selectors find."""
    return per_page(pages, keep, lambda r: kernels.spec_facts(r["html"], r["final_url"], r["spec"]), kernels.SPEC_FACTS, ["final_url", "html", "spec"])


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href, url, text of every a[href], in document order, excluded or not."""

    def kernel(row: dict) -> list[dict]:
        root = kernels.parse(row["html"])
        return [{"pos": i, "href": a.attrs["href"], "resolved": kernels.resolve(row["final_url"], a.attrs["href"]), "text": a.text().strip()} for i, a in enumerate(kernels.select(root, "a[href]"))]

    return per_page(pages, ["page_id"], kernel, "pos INT, href STRING, resolved STRING, text STRING", ["final_url", "html"])
