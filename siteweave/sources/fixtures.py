"""Relations derived from the standard tables.

Each is one SELECT that both Spark SQL and DuckDB run, with the tables' names
in braces, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_PHRASES = [
    "connectivity_blocked", "browser_navigation_failed", "extraction_failed", "render_timeout", "partial_content", "engine_error",
    "rate_limited", "csp_blocked", "csp_injection_blocked", "bot_wall", "browser_timeout", "dom_parse_error", "dns_error",
    "dns_failure", "name_resolution_failed", "network_error", "script_failure", "extraction_failure", "blocked", "blocked_request",
    "access_denied", "cloudflare_block", "unknown", "HTTP status code 429", "Security Check required", "violates CSP",
    "ECONN: connection reset by peer", "page.goto: Target closed", "navigation timeout", "request timed out", "lxml parser failed",
    "something odd", "  ", " Timeout ",
]
_POLICIES = ["default-src 'self'", "script-src 'unsafe-inline'", "script-src 'self'; script-src 'nonce-1'", "img-src *", "script-src https:; default-src *"]
_LINKS = [
    ("mailto:a@example.com", "mail"), ("#x", "top"), ("../a", "up"), ("?page=3", "more"), ("//ext.example/x", "other"), ("/tag/x", "tag"),
    ("/a.pdf", "file"), ("/cart", "Cart"), ("/page/2", "next"), ("/a/./b/../c?q=1#f", "dots"), ("sub/", "sub"), ("/z?b=2&a=1&utm_source=q", "z"),
    ("/z?a=1&b=2", "z"), ("/help", "Sign  In here"),
]


def _values(rows: list[tuple]) -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


_CATALOG = """
SELECT site_no, 's' || site_no || '.example.com' AS site, p_partkey AS pos,
  'https://s' || site_no || '.example.com' || CASE
    WHEN site_no % 5 = 0 THEN '/product/' || p_partkey
    WHEN site_no % 5 = 1 AND k % 2 = 0 THEN '/list?page=' || k
    WHEN site_no % 5 = 1 THEN '/item-' || (k % 20)
    WHEN site_no % 5 = 2 THEN '/' || CASE k % 3 WHEN 0 THEN 'news' WHEN 1 THEN 'shop' ELSE 'help' END || '/x' || k
    WHEN site_no % 5 = 3 THEN '/info-' || (k % 8)
    ELSE '/' END AS url
FROM (SELECT p_partkey, p_partkey % 25 AS site_no, CAST(floor(p_partkey / 25) AS BIGINT) AS k FROM {part}) q
"""

_SHOP = """
SELECT 'r' || r_regionkey AS site, 'https://r' || r_regionkey || '.example.com/' AS src,
  'https://r' || r_regionkey || '.example.com/nation/' || n_nationkey AS dst, n_name AS text, TRUE AS in_nav, FALSE AS in_header_footer
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT 'r' || n_regionkey, 'https://r' || n_regionkey || '.example.com/nation/' || n_nationkey,
  'https://r' || n_regionkey || '.example.com/nation/' || n_nationkey || '/customer/' || c_custkey, c_name, FALSE, FALSE
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL
SELECT 'r' || n_regionkey, 'https://r' || n_regionkey || '.example.com/nation/' || n_nationkey || '/customer/' || c_custkey,
  'https://r' || n_regionkey || '.example.com/order/' || o_orderkey, 'order ' || o_orderkey, FALSE, FALSE
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL
SELECT 'r' || n_regionkey, 'https://r' || n_regionkey || '.example.com/nation/' || n_nationkey,
  'https://r' || n_regionkey || '.example.com/', 'home', FALSE, TRUE
FROM {nation}
UNION ALL
SELECT 'r' || n_regionkey, 'https://r' || n_regionkey || '.example.com/nation/' || n_nationkey || '/customer/' || c_custkey,
  'https://r' || n_regionkey || '.example.com/', 'home', FALSE, TRUE
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""

FIXTURES: dict[str, str] = {
    "page_urls": "SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS site, page_id AS pos, url FROM {pages}",
    "catalog_urls": f"SELECT site, pos, url FROM ({_CATALOG}) c",
    "all_urls": f"SELECT page_id AS id, url FROM {{pages}} UNION ALL SELECT 1000000 + pos, url FROM ({_CATALOG}) c",
    "literal_links": f"SELECT page_id, url, n AS pos, href, text FROM {{pages}} JOIN (VALUES {_values([(i, *x) for i, x in enumerate(_LINKS)])}) AS v(n, href, text) ON TRUE",
    "shop_graph": _SHOP,
    "failures": f"""
SELECT event_id AS id, raw, CASE event_id % 7 WHEN 1 THEN 200 WHEN 2 THEN 403 WHEN 3 THEN 404 WHEN 4 THEN 429 WHEN 5 THEN 500 WHEN 6 THEN 503 END AS http_status, csp
FROM {{events}} JOIN (VALUES {_values(list(enumerate(_PHRASES)))}) AS v(n, raw) ON event_id % {len(_PHRASES)} = n
JOIN (VALUES {_values(list(enumerate([*_POLICIES, ""])))}) AS c(m, csp) ON event_id % {len(_POLICIES) + 1} = m""",
    "audit_events": """
SELECT event_id, ts, CASE user_id % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'deep' ELSE 'max' END AS scan_mode, value AS duration_ms,
  CAST(event_id % 12 AS DOUBLE) AS pages_audited, event_type = 'error' AS timeout, event_id % 10 = 0 AS degraded_mode,
  CASE WHEN event_id % 4 = 0 THEN 'partial' ELSE 'complete' END AS enrichment_status, CAST(event_id % 5 AS DOUBLE) / 10 AS fallback_rate
FROM {events}""",
    "crawl_log": """
SELECT user_id AS site, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord,
  'https://u' || user_id || '.example.com/' || event_type || '/' || event_id AS url,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS fetch_status,
  CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'render_timeout' WHEN 1 THEN 'extraction_failed' ELSE 'engine_error' END END AS failure_reason,
  value / 20 AS duration_s, '/' || event_type || '/' || (event_id % 4) AS signal
FROM {events}""",
    "page_signals": """
SELECT l_suppkey AS site, l_orderkey AS page_pos, l_linenumber AS sig_pos, l_returnflag AS type, l_linestatus AS selector,
  CASE l_linenumber % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'serious' WHEN 2 THEN 'minor' END AS severity, l_discount * 1000 AS priority_score,
  CASE l_linenumber % 7 WHEN 0 THEN 'llm' WHEN 1 THEN 'llm_cache' WHEN 2 THEN 'fix_library_cache' WHEN 3 THEN 'rule_fallback_css' WHEN 4 THEN 'rule_fallback' WHEN 5 THEN 'mystery' END AS enrichment_source
FROM {lineitem}""",
    "page_scores": """
SELECT o_custkey % 100 AS site, o_orderkey AS page, CASE WHEN o_orderkey % 6 = 0 THEN 'error' ELSE 'success' END AS audit_status,
  o_totalprice / 5000 AS score, CASE o_orderkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.9 END AS page_weight
FROM {orders}""",
    "requests": f"""
SELECT event_id AS id, request_url, 'https://www.shop.example.com/' AS seed_url, kind AS resource_type FROM {{events}}
JOIN (VALUES {_values(list(enumerate([
    "https://www.shop.example.com/a.js", "https://cdn.www.shop.example.com/b.js", "https://www.googletagmanager.com/gtm.js",
    "https://www.facebook.com/tr?id=1", "https://www.facebook.com/sdk.js", "https://widget.intercom.io/x.js", "https://fonts.gstatic.com/f.woff",
    "https://d1.cloudfront.net/analytics.js", "https://other.example.net/app.js", "https://other.example.net/pixel.gif", "https://api.mixpanel.com/track"])))})
  AS v(n, request_url) ON event_id % 11 = n
JOIN (VALUES {_values(list(enumerate(["script", "image", "XHR", "fetch", "font", "document", "Script", "media"])))}) AS k(m, kind) ON event_id % 8 = m""",
    "dom_states": """
SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS site, row_number() OVER (PARTITION BY lower(regexp_extract(url, '://([^/?#]*)', 1)) ORDER BY page_id) AS state_seq,
  CASE page_id % 4 WHEN 0 THEN 'load' WHEN 1 THEN 'menu' WHEN 2 THEN 'scroll' ELSE 'modal' END AS state_label, url, CASE WHEN page_id % 9 = 8 THEN 'same' ELSE html END AS html
FROM {pages}""",
}


def tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation over the tables in ``sf_dir``."""
    sql = FIXTURES[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(sql)})


def duck(name: str) -> str:
    """The relation as a DuckDB subquery."""
    return "(" + re.sub(r"\{(\w+)\}", r"\1", FIXTURES[name]) + ")"
