"""Properties of the URL functions on random paths."""

import random
import re

from pyspark.sql import functions as F

from pagelake.functions import urls


def test_patterns_fit_their_members(spark):
    rng = random.Random(3)
    parts = ["posts", "a.b", "12", "2024-05", "deadbeef01", "x" * 30, "über", "c+d", "(e)", "blog", "tag-1", "a" * 13]
    paths = ["/" + "/".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) + rng.choice(["", "/"]) for _ in range(300)]
    df = spark.createDataFrame([(i, f"https://Ex.com{p}") for i, p in enumerate(paths)], "i int, url string")
    u = F.col("url")
    rows = df.select("i", urls.path(u).alias("path"), urls.path_pattern(urls.path(u)).alias("pattern"), urls.normalize_loose(u).alias("once"), urls.normalize_loose(urls.normalize_loose(u)).alias("twice")).withColumn("regex", urls.pattern_regex(F.col("pattern"))).collect()
    for r in rows:
        assert r.once == r.twice and r.once.startswith("https://ex.com/")
        if r.pattern is None:
            assert not r.path.strip("/")
        else:
            assert re.search(r.regex, r.path), r
            segments = [s for s in r.path.split("/") if s]
            assert len(r.pattern.strip("/").split("/")) == len(segments)
            assert len(segments) < 2 or r.pattern.endswith("/*")


def test_render_decision_and_keys_of_odd_urls(spark):
    df = spark.createDataFrame([(None,), ("",), ("http://",), ("ftp://x/y",), ("http://u:p@h.com:8080/a",), ("http://h.com/a b",)], "url string")
    u = F.col("url")
    rows = df.select(urls.normalize_strict(u, u).alias("s"), urls.normalize_loose(u).alias("l"), urls.cache_key(u).alias("k"), urls.page_template(u).alias("t")).collect()
    assert [r.s for r in rows] == [None, None, None, None, "http://h.com:8080/a", None]
    assert rows[4].l == "http://h.com:8080/a" and rows[4].k == "h.com__user" and all(r.t is None for r in rows)
