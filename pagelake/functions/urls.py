"""URL and path-pattern functions on columns: built-in expressions only, so they stay in generated code.

They take absolute URLs; references are resolved while a page is parsed. try_parse_url gives null for what it can't
parse, and null goes through."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def host(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


def path(url: Column) -> Column:
    """The path; "/" where an http URL has none."""
    raw = part(url, "PATH")
    return F.when(raw == "", F.lit("/")).otherwise(raw)


def origin(url: Column) -> Column:
    """scheme://host[:port], without a default port."""
    scheme = F.lower(part(url, "PROTOCOL"))
    authority = F.lower(F.regexp_replace(part(url, "AUTHORITY"), r"^[^@]*@", ""))
    plain = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(authority)
    return F.concat(scheme, F.lit("://"), plain)


def normalize_loose(url: Column) -> Column:
    """Without query and fragment."""
    return F.concat(origin(url), path(url))


def normalize_strict(url: Column, base: Column) -> Column:
    """Loosely normalized; null unless it is http(s), on the host of the base and has more than the root path."""
    good = F.lower(part(url, "PROTOCOL")).isin("http", "https") & (host(url) == host(base)) & (F.length(path(url)) >= 2)
    return F.when(good, normalize_loose(url))


def segments(path_: Column) -> Column:
    return F.filter(F.split(path_, "/"), lambda s: s != "")


def encoded_length(s: Column) -> Column:
    """Length in percent-encoded form: three for each byte outside ASCII, each space and each double quote."""
    ascii_ = F.length(F.regexp_replace(s, r"[^\x00-\x7F]", ""))
    return ascii_ + 3 * (F.octet_length(s) - ascii_) + 2 * F.length(F.regexp_replace(s, '[^ "]', ""))


def is_dynamic(segment: Column, last: Column) -> Column:
    """Whether a path segment looks like an identifier."""
    looks = segment.rlike(r"^\d+$") | segment.rlike("(?i)^[a-f0-9]{8,}$") | segment.rlike("(?i)^[a-f0-9-]{20,}$") | segment.rlike(r"^\d{4}[-/]\d{2}")
    return looks | (encoded_length(segment) > 24) | (last & (encoded_length(segment) > 12))


def path_pattern(path_: Column) -> Column:
    """The path with its identifiers as *; of two or more segments the last always is one. Null without segments."""
    segs = segments(path_)
    last = lambda i: i == F.size(segs) - 1
    starred = F.transform(segs, lambda s, i: F.when(last(i) & (F.size(segs) >= 2) | is_dynamic(s, last(i)), F.lit("*")).otherwise(s))
    return F.when(F.size(segs) > 0, F.concat(F.lit("/"), F.array_join(starred, "/")))


def last_static(pattern: Column) -> Column:
    return F.try_element_at(F.filter(segments(pattern), lambda s: s != "*"), F.lit(-1))


def pattern_selector(pattern: Column) -> Column:
    found = last_static(pattern)
    return F.when(found.isNotNull(), F.concat(F.lit('a[href*="/'), found, F.lit('/"]'))).otherwise("a[href]")


def escape_regex(s: Column) -> Column:
    return F.regexp_replace(s, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def pattern_regex(pattern: Column) -> Column:
    parts = F.transform(segments(pattern), lambda s: F.when(s == "*", F.lit("[^/]+")).otherwise(escape_regex(s)))
    return F.concat(F.lit("/"), F.array_join(parts, "/"), F.lit("/?$"))


def has_page_param(url: Column) -> Column:
    return F.coalesce(part(url, "QUERY"), F.lit("")).rlike("(^|&)(page|p)(=|&|$)")


def page_template(url: Column) -> Column:
    """Path and query with the value of page (else p) replaced by {n}; null without such a parameter."""
    query = F.coalesce(part(url, "QUERY"), F.lit(""))
    name = F.when(query.rlike("(^|&)page(=|&|$)"), F.lit("page")).when(query.rlike("(^|&)p(=|&|$)"), F.lit("p"))
    put = lambda n: F.regexp_replace(query, rf"(^|&){n}(=[^&]*)?(?=&|$)", rf"$1{n}={{n}}")
    return F.concat(path(url), F.lit("?"), F.when(name == "page", put("page")).when(name == "p", put("p")))


def next_from_template(template: Column, url: Column) -> Column:
    """The template with the number after the URL's own page number (none: 1, not a number: 1 follows as 2)."""
    query = F.coalesce(part(url, "QUERY"), F.lit(""))
    value = F.regexp_extract(query, "(?:^|&)page=([^&]*)", 1)
    value = F.when(value != "", value).otherwise(F.regexp_extract(query, "(?:^|&)p=([^&]*)", 1))
    number = F.coalesce(F.try_cast(F.nullif(value, F.lit("")), "int") if hasattr(F, "try_cast") else F.nullif(value, F.lit("")).try_cast("int"), F.lit(1)) + 1
    filled = F.replace(template, F.lit("{n}"), number.cast("string"))
    return F.when(filled.rlike("^[a-z]+://"), filled).when(filled.startswith("/"), F.concat(origin(url), filled)).otherwise(F.concat(origin(url), F.regexp_replace(path(url), "[^/]*$", ""), filled))


def cache_segment(segment: Column, last: Column, only: Column) -> Column:
    looks = segment.rlike(r"^\d+$") | segment.rlike("(?i)^[a-f0-9]{8,}$") | segment.rlike("(?i)^[a-f0-9-]{20,}$")
    # Fixed value: single path segments that are kept in cache keys.
    known = segment.isin("archive", "blog", "posts", "articles", "tags", "categories")
    return F.when(looks | (last & (encoded_length(segment) > 16)), F.lit("_")).when(only & ~known, F.lit("user")).otherwise(segment)


def cache_key(url: Column) -> Column:
    segs = segments(path(url))
    parts = F.transform(segs, lambda s, i: cache_segment(s, i == F.size(segs) - 1, F.size(segs) == 1))
    return F.array_join(F.concat(F.array(F.regexp_replace(host(url), r"^www\.", "")), parts), "__")


def request_key(url: Column) -> Column:
    joined = F.array_join(F.concat(F.array(F.regexp_replace(host(url), r"^www\.", "")), segments(path(url))), "__")
    return F.coalesce(F.nullif(F.regexp_replace(joined, "[^a-zA-Z0-9._-]", "_"), F.lit("")), F.lit("request"))


def truncated_href(href: Column) -> Column:
    """A reference for a snapshot: its path, with ?... if it has a query."""
    whole = F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("/"), F.concat(F.lit("https://example.invalid"), href)).otherwise(F.concat(F.lit("https://example.invalid/"), href))
    return F.coalesce(F.concat(path(whole), F.when(F.coalesce(part(whole, "QUERY"), F.lit("")) != "", F.lit("?...")).otherwise("")), F.substring(href, 1, 80))


def trim_all(s: Column) -> Column:
    """Without white space, of any kind, at the ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def needs_rendering(html: Column) -> Column:
    """Whether a page is probably built by scripts: an application root, or many scripts with few links or little text."""
    low = F.lower(html)
    rooted = F.lit(False)
    # Marks of an application root.
    for mark in ('id="__next"', "id='__next'", 'id="root"', "id='root'", "data-reactroot"):
        rooted = rooted | F.contains(low, F.lit(mark))
    text = F.regexp_replace(low, r"(?s)<script\b.*?</script>", "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<style\b.*?</style>", ""), r"(?s)<[^>]+>", " ")
    chars = F.length(F.regexp_replace(text, r"\s+", ""))
    return F.coalesce(rooted | ((F.regexp_count(low, F.lit(r"<script\b")) >= 8) & ((F.regexp_count(low, F.lit(r"<a\b")) < 5) | (chars < 800))), F.lit(False))
