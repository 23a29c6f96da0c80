"""The registered query of each operator: it applies the operator to the whole table and derives the digest columns."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fertility, line_dedup, mih, minmax, mixing, ordinal, packing, token_counts, url_filters, warc
from .shared import only


def vocab(name: str) -> str:
    """The place of a public vocabulary file: in the folder PAGELAKE_TOKENIZERS names, else of the installed package."""
    folder = os.environ.get("PAGELAKE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (host, path, verdict)
SITES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: The method's own globs, for URLs that no site rule fits.
JUNK = tuple(url_filters.Rule(f"*{word}*", f"*{word}*", "block") for word in ("cheap-pills", "spam-farm", "casino", "warez"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filters.site_rule(*site) for site in SITES]
    judged = url_filters.filter_urls(only(table(spark, sf_dir, "pages"), "page_id", "url"), rules, "allow", list(JUNK))
    return judged.select("page_id", "host", "path", "rule", "verdict", "pattern")


OP1_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parts
), ruled AS (
  SELECT *, '.' || host AS h, CASE
    WHEN suffix('.' || host, '.www.example.com') AND prefix(path, '/en/') THEN 'www.example.com/en/'
    WHEN suffix('.' || host, '.example.com') AND prefix(path, '/en/') THEN 'example.com/en/'
    WHEN suffix('.' || host, '.net') AND prefix(path, '/es/') THEN 'net/es/'
    WHEN suffix('.' || host, '.net') AND prefix(path, '/fr/') THEN 'net/fr/'
    WHEN suffix('.' || host, '.com') AND prefix(path, '/') THEN 'com/' END AS rule
  FROM named
), globbed AS (
  SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
    WHEN contains(h || path, 'cheap-pills') THEN '*cheap-pills*' WHEN contains(h || path, 'spam-farm') THEN '*spam-farm*'
    WHEN contains(h || path, 'casino') THEN '*casino*' WHEN contains(h || path, 'warez') THEN '*warez*' END AS pattern FROM ruled
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       pattern
FROM globbed
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two records for each page: its metadata and its plain text, with their own and their source's digests."""
    responses = warc.responses_of(table(spark, sf_dir, "pages"), "2024-01-01T00:00:00Z")
    made = warc.derivatives(responses)
    return made.select("record_id", "type", "refers_to", "target_uri", "date", "content_type", "block_digest", "payload_digest", "source_digest", F.length("block").cast("long").alias("block_length"), F.decode("block", "UTF-8").alias("block"))


def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(table(spark, sf_dir, "documents"), vocab("piece_bpe_32k.model"), ["doc_id"])


def op4_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 2 for documents of high quality that are not toxic, 1 with one of these two, 0 with neither; kept: most likely the top grade."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = ordinal.fit(docs, labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade")), levels=3)
    scored = ordinal.score(docs, model, ["doc_id"], least_grade=2, least=0.5)
    return scored.select("doc_id", "expected_grade", F.element_at("tails", -1).alias("tail_probability"), "kept")


def op5_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85, bands=24, rows=6)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocab("word_bpe_49k.json"), 4096, 1)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocab("byte_bpe_50k.json"), ["doc_id"], 512)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(only(table(spark, sf_dir, "documents"), "doc_id", "text"), percent=80)
    return cut.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, max_repeats=2).select("doc_id", "size", "source_size", "target", "taken", "copies")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL}
