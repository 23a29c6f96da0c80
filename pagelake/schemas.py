"""Schemas of the engine's relations."""

SPEC = (
    "STRUCT<id:STRING, listing:STRUCT<article_link_selector:STRING, article_link_href_pattern:STRING, container_selector:STRING, exclude_selectors:ARRAY<STRING>>, "
    "article:STRUCT<method:STRING, content_selector:STRING, metadata_selectors:STRUCT<title:STRING, author:STRING, published_at:STRING, tags:STRING>>, "
    "pagination:STRUCT<method:STRING, selector:STRING, text_patterns:ARRAY<STRING>, url_template:STRING>, "
    "wait_strategy:STRUCT<after_navigation:STRING, after_load_more_ms:INT, max_wait_ms:INT>, evidence:STRING>"
)
PAGES = "page_id BIGINT, requested_url STRING, final_url STRING, status INT, html STRING, source STRING, render_mode STRING"
NODES = "page_id BIGINT, node_id INT, end_id INT, parent_id INT, depth INT, bfs_pos INT, tag STRING, attrs MAP<STRING,STRING>, elem_id STRING, classes ARRAY<STRING>, direct_text STRING, text STRING"
CACHE = f"cache_key STRING, url_pattern STRING, spec {SPEC}, generated_at TIMESTAMP, engine_version STRING, sample_url STRING, hit_count INT, zero_result_count INT, last_used_at TIMESTAMP, validation_status STRING"
ISSUES = "ARRAY<STRUCT<severity:STRING, code:STRING, message:STRING, selector:STRING>>"

# The regions that listing analysis leaves out, the smallest cluster of links, and the limits of a run.
EXCLUDE_SELECTORS = (
    "nav",
    "header",
    "footer",
    "aside",
    '[role="navigation"]',
    '[aria-label*="navigation" i]',
    '[class*="nav" i]',
    '[class*="menu" i]',
    '[class*="sidebar" i]',
    '[class*="footer" i]',
    '[class*="recommend" i]',
    '[class*="related" i]',
    '[class*="breadcrumb" i]',
)
MIN_CLUSTER = 3
CONTENT_CHARS = 80
CONFIDENCE = 0.7
TOP_CANDIDATES = 8
MAX_ITERATIONS = 100
MAX_SECONDS = 300.0
STALE_LIMIT = 5
CACHE_DAYS = 30
ZERO_RESULTS = 3
DEFAULT_LIMIT = 100
PREVIEW_ITERATIONS, PREVIEW_LIMIT, PREVIEW_SECONDS = 3, 10, 15.0
WAIT = ("domcontentloaded", 1500, 30000)
ENGINE_VERSION = "0.1.0"


def spec_value(link_selector: str, href_pattern: str, container: str | None = None, excludes: list[str] | None = None, method: str = "readability", content: str | None = None, metadata: dict | None = None, pagination: str = "none", pagination_selector: str | None = None, text_patterns: list[str] | None = None, url_template: str | None = None, evidence: str = "given") -> dict:
    """A spec as the nested dictionary that createDataFrame takes for SPEC."""
    meta = {k: (metadata or {}).get(k) for k in ("title", "author", "published_at", "tags")} if metadata is not None else None
    return {
        "id": None,
        "listing": {"article_link_selector": link_selector, "article_link_href_pattern": href_pattern, "container_selector": container, "exclude_selectors": excludes},
        "article": {"method": method, "content_selector": content, "metadata_selectors": meta},
        "pagination": {"method": pagination, "selector": pagination_selector, "text_patterns": text_patterns, "url_template": url_template},
        "wait_strategy": dict(zip(("after_navigation", "after_load_more_ms", "max_wait_ms"), WAIT)),
        "evidence": evidence,
    }


#: The spec under which a single page is taken as an article.
SINGLE_ARTICLE = spec_value("a[href]", ".*", evidence="single article")
