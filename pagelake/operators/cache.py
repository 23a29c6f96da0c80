"""The keyed table of validated specs: lookup with its reasons, upserts, and how entries age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..functions import urls
from ..sources.pages import of_pages
from .lineage import checkpoint
from . import specs, validate

_FILE = "cacheKey STRING, urlPattern STRING, spec STRING, generatedAt STRING, engineVersion STRING, sampleUrl STRING, hitCount INT, zeroResultCount INT, lastUsedAt STRING, validationStatus STRING"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.CACHE)


def is_stale(as_of: Column, days: int = schemas.CACHE_DAYS, zero_results: int = schemas.ZERO_RESULTS) -> Column:
    """Marked stale, too often without result, of unknown age, or older than so many days."""
    age = F.unix_millis(as_of) - F.unix_millis(F.col("generated_at"))
    return (F.col("validation_status") == "stale") | (F.col("zero_result_count") >= zero_results) | F.col("generated_at").isNull() | (age > days * 86_400_000)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A folder of one JSON file per entry -> the cache's columns, and problem: corrupt or invalid, else null."""
    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.col("value").alias("raw"))
    parsed = F.from_json("raw", _FILE)
    rows = files.withColumn("p", F.when(specs.is_json_object(F.col("raw")), parsed))
    rows = specs.parse_specs(rows.withColumn("spec_json", F.col("p.spec")), "spec_json")
    time = lambda c: F.try_to_timestamp(F.col(c))
    count = lambda c: F.col(c).isNull() | (F.col(c) < 0)
    wrong = F.col("spec_error").isNotNull() | time("p.generatedAt").isNull() | time("p.lastUsedAt").isNull() | urls.host(F.col("p.sampleUrl")).isNull() | count("p.hitCount") | count("p.zeroResultCount") | ~F.coalesce(F.col("p.validationStatus").isin("verified", "stale"), F.lit(False)) | F.coalesce(F.col("p.cacheKey"), F.lit("")).isin("")
    problem = F.when(F.col("p").isNull(), F.lit("corrupt")).when(wrong, F.lit("invalid"))
    key = F.coalesce("p.cacheKey", F.regexp_extract("file", r"([^/]+)\.json$", 1))
    return rows.select(key.alias("cache_key"), F.col("p.urlPattern").alias("url_pattern"), "spec", time("p.generatedAt").alias("generated_at"), F.col("p.engineVersion").alias("engine_version"), F.col("p.sampleUrl").alias("sample_url"), F.col("p.hitCount").alias("hit_count"), F.col("p.zeroResultCount").alias("zero_result_count"), time("p.lastUsedAt").alias("last_used_at"), F.col("p.validationStatus").alias("validation_status"), problem.alias("problem"))


def to_files(cache: DataFrame) -> DataFrame:
    """name, content of the JSON file of each entry."""
    stamp = lambda c: F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    content = F.to_json(F.struct(F.col("cache_key").alias("cacheKey"), F.col("url_pattern").alias("urlPattern"), F.parse_json(specs.to_json(F.col("spec"))).alias("spec"), stamp("generated_at").alias("generatedAt"), F.col("engine_version").alias("engineVersion"), F.col("sample_url").alias("sampleUrl"), F.col("hit_count").alias("hitCount"), F.col("zero_result_count").alias("zeroResultCount"), stamp("last_used_at").alias("lastUsedAt"), F.col("validation_status").alias("validationStatus")))
    return cache.select(F.concat(F.regexp_replace("cache_key", "[^a-zA-Z0-9._-]", "_"), F.lit(".json")).alias("name"), F.concat(content, F.lit("\n")).alias("content"))


def lookup(pages: DataFrame, cache: DataFrame, as_of: Column, refresh: bool = False, days: int = schemas.CACHE_DAYS, zero_results: int = schemas.ZERO_RESULTS) -> DataFrame:
    """pages(page_id, final_url, html) -> page_id, cache_key, reason, message, spec (of a hit), issues, link_count, unique_url_count.

    Reasons in order: bypassed or absent miss, corrupt, invalid, stale, validation-failed, hit. Only entries that are good
    so far are validated, so pages without one are not parsed."""
    problem = F.col("problem") if "problem" in cache.columns else F.lit(None).cast("string")
    entries = cache.withColumn("problem", problem).withColumn("stale", F.coalesce(is_stale(as_of, days, zero_results), F.lit(True))).select("cache_key", "spec", "problem", "stale", "generated_at", F.lit(not refresh).alias("found"))
    # Of entries with one key the newest counts. Keys meet entries without HTML.
    newest = F.row_number().over(Window.partitionBy("cache_key").orderBy(F.desc_nulls_last("generated_at"), F.to_json("spec")))
    entries = entries.withColumn("_r", newest).where("_r = 1").drop("_r", "generated_at")
    keyed = checkpoint(pages.select("page_id", "final_url", urls.cache_key(F.col("final_url")).alias("cache_key")).join(entries, "cache_key", "left"))
    usable = F.coalesce(F.col("found") & F.col("problem").isNull() & ~F.col("stale"), F.lit(False))
    checked = validate.validate(of_pages(keyed.where(usable), pages, "page_id", "final_url", "spec"))
    rows = keyed.drop("final_url").withColumn("usable", usable).join(checked, "page_id", "left")
    reason = (
        F.when(~F.coalesce("found", F.lit(False)), "miss")
        .when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("stale"), "stale")
        .when(~F.col("valid"), "validation-failed")
        .otherwise("hit")
    )
    told = F.array_join(F.transform("issues", lambda i: F.concat(i["code"], F.lit(": "), i["message"])), "; ")
    rows = rows.withColumn("reason", reason)
    message = (
        F.when(F.lit(refresh), "cache bypassed")
        .when(F.col("reason") == "stale", F.concat(F.lit("cache entry "), F.col("cache_key"), F.lit(" is stale")))
        .when(F.col("reason") == "validation-failed", told)
    )
    return rows.select("page_id", "cache_key", "reason", message.alias("message"), F.when(F.col("reason") == "hit", F.col("spec")).alias("spec"), "issues", "link_count", "unique_url_count")


def after_lookup(cache: DataFrame, looked: DataFrame, as_of: Column, zero_results: int = schemas.ZERO_RESULTS) -> DataFrame:
    """The cache with its counters moved on: hits count and reset the zero results; failed validations count as these."""
    seen = looked.groupBy("cache_key").agg(F.count_if(F.col("reason") == "hit").cast("int").alias("hits"), F.count_if(F.col("reason") == "validation-failed").cast("int").alias("fails"))
    rows = cache.join(seen, "cache_key", "left").withColumns({"hits": F.coalesce("hits", F.lit(0)), "fails": F.coalesce("fails", F.lit(0))})
    zero = F.when(F.col("hits") > 0, F.lit(0)).otherwise(F.col("zero_result_count")) + F.col("fails")
    status = F.when((F.col("fails") > 0) & (zero >= zero_results), F.lit("stale")).otherwise(F.col("validation_status"))
    rows = rows.withColumns({"hit_count": F.col("hit_count") + F.col("hits"), "validation_status": status, "last_used_at": F.when(F.col("hits") > 0, as_of).otherwise(F.col("last_used_at"))})
    return rows.withColumn("zero_result_count", zero).select(*cache.columns)


def record_zero_result(cache: DataFrame, keys: DataFrame, zero_results: int = schemas.ZERO_RESULTS) -> DataFrame:
    """The cache after one more empty result for each of keys(cache_key)."""
    looked = keys.select("cache_key").distinct().withColumn("reason", F.lit("validation-failed"))
    return after_lookup(cache, looked, F.current_timestamp(), zero_results)


def save(cache: DataFrame, resolved: DataFrame, as_of: Column, version: str = schemas.ENGINE_VERSION) -> DataFrame:
    """The cache with fresh entries for resolved(final_url, spec, valid). What isn't valid is refused; of one key the last URL stays."""
    new = resolved.where("valid AND spec IS NOT NULL").select(
        urls.cache_key(F.col("final_url")).alias("cache_key"), F.col("spec.listing.article_link_href_pattern").alias("url_pattern"), "spec", as_of.alias("generated_at"), F.lit(version).alias("engine_version"),
        F.col("final_url").alias("sample_url"), F.lit(0).alias("hit_count"), F.lit(0).alias("zero_result_count"), as_of.alias("last_used_at"), F.lit("verified").alias("validation_status"),
    )
    both = cache.select(*new.columns).withColumn("new", F.lit(0)).unionByName(new.withColumn("new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("cache_key").orderBy(F.desc("new"), F.desc("sample_url")))
    return both.withColumn("r", rank).where("r = 1").drop("r", "new")


def store(entries: DataFrame, path: str) -> int:
    """Writes the whole table as the next generation under a path, and gives its number; readers of the one before aren't disturbed."""
    spark = entries.sparkSession
    number = (_newest(spark, path) or 0) + 1
    entries.select(*empty(spark).columns).write.mode("overwrite").parquet(f"{path}/generation={number}")
    return number


def load(spark: SparkSession, path: str) -> DataFrame:
    """The newest generation under a path; no entries if there is none."""
    number = _newest(spark, path)
    return empty(spark) if number is None else spark.read.schema(schemas.CACHE).parquet(f"{path}/generation={number}")


def _newest(spark: SparkSession, path: str) -> int | None:
    """The highest generation that was written to its end."""
    jvm = spark.sparkContext._jvm
    marks = jvm.org.apache.hadoop.fs.Path(f"{path}/generation=*/_SUCCESS")
    found = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks) or []
    return max((int(x.getPath().getParent().getName().partition("=")[2]) for x in found), default=None)


def renewed(entries: DataFrame, resolution: DataFrame, as_of: Column, zero_results: int = schemas.ZERO_RESULTS) -> DataFrame:
    """The cache after a run of the cascade: hits and failures counted, and specs found otherwise saved."""
    counted = after_lookup(entries, resolution.select("cache_key", "reason"), as_of, zero_results)
    return save(counted, resolution.where(F.col("source").isin("heuristic", "provider")), as_of)
