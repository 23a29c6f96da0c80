"""The engine's functions for SQL: html_nodes and html_links as table functions, url_resolve, html_to_markdown and html_article."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..dom import kernels
from ..dom.markdown import html_to_markdown as to_markdown


class HtmlNodes:
    def eval(self, html: str):
        for n in kernels.dom_nodes(html):
            yield n["node_id"], n["end_id"], n["parent_id"], n["depth"], n["tag"], n["attrs"], n["direct_text"], n["text"]


class HtmlLinks:
    def eval(self, html: str, base: str):
        root = kernels.parse(html)
        for pos, a in enumerate(kernels.select(root, "a[href]")):
            yield pos, a.attrs["href"], kernels.resolve(base, a.attrs["href"]), a.text().strip()


def register(spark: SparkSession) -> None:
    """Registers all functions in a session."""
    spark.udtf.register("html_nodes", F.udtf(HtmlNodes, returnType="node_id int, end_id int, parent_id int, depth int, tag string, attrs map<string,string>, direct_text string, text string"))
    spark.udtf.register("html_links", F.udtf(HtmlLinks, returnType="pos int, href string, url string, text string"))

    @F.pandas_udf("string")
    def url_resolve(base: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series([kernels.resolve(b, r) for b, r in zip(base, ref)], dtype=object)

    @F.pandas_udf("string")
    def html_to_markdown(html: pd.Series) -> pd.Series:
        return html.map(to_markdown)

    @F.pandas_udf("title string, author string, published_at string, body_html string, markdown string, excerpt string, error string")
    def html_article(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        rows = [kernels.article(h, u) for h, u in zip(html, url)]
        return pd.DataFrame(rows, columns=["title", "author", "published_at", "body_html", "markdown", "excerpt", "error"])

    for name, f in (("url_resolve", url_resolve), ("html_to_markdown", html_to_markdown), ("html_article", html_article)):
        spark.udf.register(name, f)
