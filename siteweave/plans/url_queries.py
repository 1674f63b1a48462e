"""URL, link and topology queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, rules, urls
from ..operators import links, topology
from ..sources.fixtures import duck, fixture
from . import sql as q

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


ALL = duck("all_urls")



@query(f"SELECT id, {q.normalize('url')} AS normalized FROM {ALL}")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "all_urls").select("id", urls.normalize(F.col("url")).alias("normalized"))


@query(f"SELECT id, {q.dedup_key('url')} AS dedup_key FROM {ALL}")
def url_dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "all_urls").select("id", urls.dedup_key(F.col("url")).alias("dedup_key"))


@query(f"SELECT id, {q.origin('url')} AS origin, len({q.segments(q.path('url'))})::INT AS depth FROM {ALL}")
def url_origin_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "all_urls").select("id", urls.origin(F.col("url")).alias("origin"), urls.depth(F.col("url")).alias("depth"))


@query(f"""SELECT id, {q.suffix(f"lower({q.path('url')})", rules.BINARY_EXTENSIONS)} AS is_binary, {q.boost('url')} AS boost, {q.critical_type('url')} AS critical_type,
  {q.path('url')} IN ('', '/', '/index.html', '/index.htm') AS is_homepage, regexp_matches(url, '{rules.PAGINATION}') AS is_paginated, {q.template_signal('url')} AS signal,
  CASE WHEN lower({q.path('url')}) IN ('', '/', '/index.html') THEN 'home' WHEN contains(lower({q.path('url')}), 'page-') THEN 'pagination'
    WHEN contains(lower({q.path('url')}), 'category') THEN 'category' WHEN contains(lower({q.path('url')}), 'catalogue/') THEN 'product' ELSE 'other' END AS kind FROM {ALL}""")
def url_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "all_urls").select(
        "id",
        urls.has_binary_extension(F.col("url")).alias("is_binary"),
        urls.priority_boost(F.col("url")).alias("boost"),
        urls.critical_type(F.col("url")).alias("critical_type"),
        urls.is_homepage(F.col("url")).alias("is_homepage"),
        urls.is_paginated(F.col("url")).alias("is_paginated"),
        urls.template_signal(F.col("url")).alias("signal"),
        urls.bench_page_type(F.col("url")).alias("kind"),
    )


@query(f"SELECT page_id, pos, href, {q.resolve('url', 'href')} AS resolved FROM {duck('literal_links')}")
def url_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "literal_links")
    return rows.select("page_id", F.col("pos").cast("int").alias("pos"), "href", urls.resolve(F.col("url"), F.col("href")).alias("resolved"))


@query(f"""SELECT page_id, pos, href, {q.prefix('lower(trim(href))', rules.SKIP_HREF_PREFIXES)} OR {q.any_of(f"lower({q.path('href')})", rules.SKIP_PATH_FRAGMENTS)} AS skipped
  FROM {duck('literal_links')}""")
def href_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "literal_links")
    return rows.select("page_id", F.col("pos").cast("int").alias("pos"), "href", urls.should_skip_href(F.col("href")).alias("skipped"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


@query(f"SELECT page_id, pos::INT AS pos, href, text, in_nav, in_header_footer FROM {q.anchors()}")
def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.page_links(_pages(spark, sf_dir)).drop("url")


@query(f"SELECT page_id, pos::INT AS pos, href, text, in_nav, in_header_footer FROM {q.anchors()}")
def page_anchors_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.page_links(_pages(spark, sf_dir), exact=True).drop("url")


@query(f"SELECT in_nav, in_header_footer, count(*)::BIGINT AS n, count(DISTINCT page_id)::BIGINT AS n_pages FROM {q.anchors()} GROUP BY ALL")
def anchor_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.page_links(_pages(spark, sf_dir))
    return found.groupBy("in_nav", "in_header_footer").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("n_pages"))


def _all_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.page_links(_pages(spark, sf_dir)).select("page_id", "url", "href", "text", "in_nav", "in_header_footer")
    more = fixture(spark, sf_dir, "literal_links").select("page_id", "url", "href", "text", F.lit(False).alias("in_nav"), F.lit(False).alias("in_header_footer"))
    return found.unionByName(more)


def _judged(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    return links.judged_links(_all_links(spark, sf_dir), urls.host(F.col("url")), F.lit(depth))


def _judged_sql(depth: int) -> str:
    return f"""(SELECT *, coalesce({q.skip_reason('fetch_url', q.host('url'), depth)}, CASE WHEN dedup_key = '' THEN 'exclusion_rule' WHEN {depth} >= 2 AND page_type = 'standard' THEN 'low_value_depth' END) AS reason
  FROM (SELECT *, {q.dedup_key('fetch_url')} AS dedup_key, {q.page_type('fetch_url', 'text', 'in_nav', 'in_header_footer')} AS page_type
  FROM (SELECT page_id, url, {q.collapse('text')} AS text, in_nav, in_header_footer, {q.resolve('url', 'trim(href)')} AS fetch_url FROM (
    SELECT page_id, url, href, text, in_nav, in_header_footer FROM {q.anchors()} UNION ALL SELECT page_id, url, href, text, FALSE, FALSE FROM {duck('literal_links')}) WHERE trim(href) <> '')))"""


def _selected_sql(depth: int) -> str:
    return f"""SELECT page_id, dedup_key, fetch_url, page_type, {q.weight('page_type')} AS page_weight, {q.tier('page_type')}::INT AS tier FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, dedup_key ORDER BY {q.tier('page_type')}, fetch_url, page_type) AS r FROM {_judged_sql(depth)} WHERE reason IS NULL) WHERE r = 1"""


@query(_selected_sql(1))
def links_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.selected_links(_judged(spark, sf_dir, 1))


@query(_selected_sql(3))
def links_selected_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.selected_links(_judged(spark, sf_dir, 3))


@query(f"SELECT page_id, fetch_url AS url, reason FROM {_judged_sql(1)} WHERE reason IS NOT NULL")
def links_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.skipped_links(_judged(spark, sf_dir, 1))


@query(f"SELECT reason, count(*)::BIGINT AS n FROM {_judged_sql(3)} WHERE reason IS NOT NULL GROUP BY reason")
def skip_reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.skipped_links(_judged(spark, sf_dir, 3)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT dedup_key, min(id)::BIGINT AS first_id, count(*)::BIGINT AS seen FROM (SELECT id, {q.dedup_key('url')} AS dedup_key FROM {ALL}) GROUP BY dedup_key")
def dedup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "all_urls").select("id", urls.dedup_key(F.col("url")).alias("dedup_key"))
    return rows.groupBy("dedup_key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("seen"))


# topology ------------------------------------------------------------------

SITES = f"(SELECT site, pos, url FROM {duck('page_urls')} UNION ALL SELECT site, pos, url FROM {duck('catalog_urls')})"
_PARTS = "string_split(trim(path, '/'), '/')"
_CAPPED = f"""u AS (SELECT site, url, min(pos) AS pos FROM {SITES} GROUP BY site, url),
c AS (SELECT *, {q.path('url')} AS path, regexp_matches(url, '{rules.PAGINATION}') AS paginated FROM (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY pos, url) AS rn FROM u) WHERE rn <= {rules.TOPOLOGY_CAP}),
seg AS (SELECT site, unnest({_PARTS}) AS segment, unnest(range(0, len({_PARTS}))) AS place FROM c WHERE NOT paginated),
tot AS (SELECT site, count(*) AS paths FROM c WHERE NOT paginated GROUP BY site),
st AS (SELECT site, place, segment, count(*)::DOUBLE / any_value(paths) AS share FROM seg JOIN tot USING (site) WHERE segment <> '' GROUP BY site, place, segment HAVING count(*)::DOUBLE / any_value(paths) >= 0.30::DOUBLE)"""
_NAMED = f"""{_CAPPED},
k AS (SELECT site, list({{'place': place, 'segment': segment}}) AS kept FROM st GROUP BY site),
n AS (SELECT c.*, CASE WHEN NOT paginated THEN '/' || array_to_string(list_filter(list_transform({_PARTS}, lambda s, i: CASE WHEN s = '' THEN NULL
  WHEN list_contains(coalesce(kept, []), {{'place': i - 1, 'segment': s}}) THEN s WHEN regexp_matches(s, '^[0-9]+$') THEN '{{id}}'
  WHEN regexp_matches(s, '{rules.SEGMENT_UUID}') THEN '{{uuid}}' ELSE '{{slug}}' END), lambda x: x IS NOT NULL), '/') END AS template FROM c LEFT JOIN k USING (site))"""
_LABELS = f"""{_NAMED},
g AS (SELECT site, template, count(*) AS n FROM n WHERE NOT paginated GROUP BY site, template),
s AS (SELECT site, count(*) AS urls, count(*) FILTER (paginated) AS paginated, count(*) FILTER (NOT paginated) AS plain FROM n GROUP BY site),
gm AS (SELECT site, max(n) AS largest, count(*) AS templates FROM g GROUP BY site),
l AS (SELECT site, urls, paginated, coalesce(templates, 0) AS templates, CASE WHEN urls = 1 THEN 'single_page'
  WHEN plain > 20 AND largest / plain >= 0.5 THEN 'deep_uniform' WHEN paginated / urls > 0.1 THEN 'paginated' WHEN coalesce(templates, 0) >= 3 THEN 'multi_template' ELSE 'thin' END AS topology FROM s LEFT JOIN gm USING (site))"""
_QUOTA = "CASE topology " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.TOPOLOGY_QUOTA.items()) + " END"
_SAMPLE = f"""{_LABELS},
p AS (SELECT n.*, topology, g.n AS size, row_number() OVER (PARTITION BY n.site, n.template ORDER BY CASE WHEN {q.query('url')} <> '' THEN 1 ELSE 0 END, len({_PARTS}), length(url), pos, url) AS choice
  FROM n JOIN g ON g.site = n.site AND g.template = n.template JOIN l ON l.site = n.site WHERE NOT n.paginated),
ch AS (SELECT * FROM p WHERE choice <= {_QUOTA})"""


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "page_urls").unionByName(fixture(spark, sf_dir, "catalog_urls"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.with_templates(topology.capped(topology.first_seen(_sites(spark, sf_dir))))


@query(f"WITH {_CAPPED} SELECT site, place::INT AS place, segment, round(share, 6) AS share FROM st")
def structural_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topology.capped(topology.first_seen(_sites(spark, sf_dir))).where(~urls.is_paginated(F.col("url")))
    found = topology.structural_segments(rows.withColumn("path", urls.path(F.col("url"))))
    return found.withColumn("share", F.round("share", 6))


@query(f"WITH {_NAMED} SELECT site, pos, url, paginated, template FROM n")
def url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("site", "pos", "url", "paginated", "template")


@query(f"WITH {_SAMPLE} SELECT site, template, size::BIGINT AS group_size, choice::INT AS choice, url, pos FROM ch")
def template_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _named(spark, sf_dir)
    return topology.samples(named, topology.site_labels(named))


@query(f"""WITH {_SAMPLE}, h AS (SELECT site, arg_min(url, pos) AS homepage FROM n WHERE path IN ('', '/', '/index.html', '/index.htm') GROUP BY site),
f AS (SELECT site, arg_min(url, pos) AS first FROM n GROUP BY site),
t AS (SELECT site, count(*) AS total FROM u GROUP BY site),
pk AS (SELECT site, count(*) AS chosen, list(url ORDER BY size DESC, template, choice) AS urls FROM ch GROUP BY site)
SELECT l.site, topology, CASE WHEN topology = 'single_page' THEN 1 ELSE templates END::BIGINT AS templates_found, total::BIGINT AS total_discovered,
  CASE WHEN topology = 'single_page' THEN l.paginated ELSE l.urls - coalesce(chosen, 0) END::BIGINT AS skipped_urls,
  CASE WHEN topology = 'single_page' THEN coalesce(homepage, first) WHEN homepage IS NOT NULL THEN array_to_string(list_concat([homepage], list_filter(coalesce(pk.urls, []), lambda x: x <> homepage)), ' ')
  ELSE array_to_string(coalesce(pk.urls, []), ' ') END AS crawl_urls
FROM l JOIN t USING (site) LEFT JOIN pk USING (site) LEFT JOIN h USING (site) LEFT JOIN f USING (site)""")
def site_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.detect_topology(_sites(spark, sf_dir)).withColumn("crawl_urls", F.array_join("crawl_urls", " ")).withColumn("templates_found", F.col("templates_found").cast("long"))


@query(f"""WITH {_LABELS} SELECT topology, count(*)::BIGINT AS sites, sum(urls)::BIGINT AS urls FROM l GROUP BY topology""")
def topology_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = topology.site_labels(_named(spark, sf_dir))
    return labels.groupBy("topology").agg(F.count(F.lit(1)).alias("sites"), F.sum("urls").alias("urls"))


# pages ------------------------------------------------------------------------


@query("""SELECT page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g'),
  '(?is)<head\\b.*?</head\\s*>|<nav\\b.*?</nav\\s*>|<footer\\b.*?</footer\\s*>|<aside\\b.*?</aside\\s*>|<form\\b.*?</form\\s*>', ' ', 'g'), '[\\s ]+', ' ', 'g'),
  '(?i)</?(?:p|div|section|article|main|h[1-6]|ul|ol|li|table|tr|blockquote|pre)\\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), chr(10)),
  lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\\s ]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS content FROM pages""")
def page_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", html.content(F.col("html")).alias("content"))


@query("""SELECT page_id, CASE WHEN regexp_matches(lower(html), 'id\\s*=\\s*["'']?__next["''\\s>]') THEN 'next' WHEN contains(lower(html), '<app-root') THEN 'angular' END AS framework,
  CASE WHEN regexp_matches(lower(url), '/login|/signin|/auth|/oauth|/sso|/accounts') THEN 'url_login_redirect' WHEN regexp_matches(lower(html), '<input\\b[^>]*type\\s*=\\s*["'']?password') THEN 'password_field_present' ELSE 'none' END AS login FROM pages""")
def page_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", html.spa_framework(F.col("html")).alias("framework"), html.login_wall(F.col("html"), F.col("url")).alias("login"))
