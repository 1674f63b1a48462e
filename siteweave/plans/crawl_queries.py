"""Discovery, sitemap, crawl, session, report and stream queries with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import html, urls
from ..operators import crawl, discovery, events, links, report, scoring, sitemaps, store
from ..sources.fixtures import duck, fixture
from ..sources.scratch import own_dir
from ..streaming import jobs
from . import sql as q
from .audit_queries import ORACLES as AUDIT_ORACLES

INFO_GAIN = AUDIT_ORACLES["info_gain_stop"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


# discovery ----------------------------------------------------------------------

_FOUND = f"""(SELECT url, 'sitemap' AS source, CAST(id % 4 AS INT) AS depth, CAST(id % 10 AS DOUBLE) / 10 AS priority FROM {duck('all_urls')}
  UNION ALL SELECT url, 'discovery', CAST(id % 5 AS INT), CAST(0.9 AS DOUBLE) FROM {duck('all_urls')} WHERE id % 2 = 0
  UNION ALL SELECT url, 'dom', 0, CAST(0.9 AS DOUBLE) FROM {duck('all_urls')} WHERE id % 5 = 0
  UNION ALL SELECT 'https://' || site || '/login', 'dom', 1, CAST(0.5 AS DOUBLE) FROM {duck('page_urls')} WHERE pos % 2 = 0
  UNION ALL SELECT 'https://' || site || '/contact?x=' || (pos % 3), 'sitemap', 3, CAST(0.1 AS DOUBLE) FROM {duck('page_urls')} WHERE pos % 3 = 0)"""
_MERGED = f"""(SELECT url, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, min(depth) AS depth, max(priority) AS base_priority, {q.critical_type('url')} AS page_type, {q.origin('url')} AS site
  FROM (SELECT {q.normalize('url')} AS url, source, depth, CASE WHEN source = 'sitemap' THEN priority ELSE 0.5::DOUBLE END AS priority FROM {_FOUND}) GROUP BY url)"""
_SCORED = f"""(SELECT *, round(base_priority + {q.boost('url')} + CASE WHEN contains(sources, 'sitemap') AND contains(sources, 'discovery') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN depth <= 2 THEN 0.1::DOUBLE ELSE 0 END, 9) AS priority_score FROM {_MERGED})"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, p = fixture(spark, sf_dir, "all_urls"), fixture(spark, sf_dir, "page_urls")
    i, half = F.col("id"), F.lit(0.9)
    part = lambda df, url, source, depth, priority: df.select(url.alias("url"), F.lit(source).alias("source"), depth.cast("int").alias("depth"), priority.alias("priority"))
    out = part(a, F.col("url"), "sitemap", i % 4, (i % 10).cast("double") / 10)
    out = out.unionByName(part(a.where("id % 2 = 0"), F.col("url"), "discovery", i % 5, half))
    out = out.unionByName(part(a.where("id % 5 = 0"), F.col("url"), "dom", F.lit(0), half))
    site = F.concat(F.lit("https://"), "site")
    out = out.unionByName(part(p.where("pos % 2 = 0"), F.concat(site, F.lit("/login")), "dom", F.lit(1), F.lit(0.5)))
    return out.unionByName(part(p.where("pos % 3 = 0"), F.concat(site, F.lit("/contact?x="), F.col("pos") % 3), "sitemap", F.lit(3), F.lit(0.1)))


@query(f"SELECT url, sources, depth, base_priority, page_type, site FROM {_MERGED}")
def discovery_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.merge_sources(_found(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


@query(f"SELECT site, url, depth, priority_score, page_type FROM {_SCORED}")
def discovery_prioritized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.prioritized(discovery.merge_sources(_found(spark, sf_dir))).select("site", "url", "depth", "priority_score", "page_type")


_RANKED = f"""r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY priority_score DESC, depth, url) AS rank, row_number() OVER (PARTITION BY site, page_type ORDER BY priority_score DESC, depth, url) AS nth FROM {_SCORED}),
t AS (SELECT *, page_type IS NOT NULL AND nth = 1 AS is_first FROM r WHERE rank <= 5),
m AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_type) AS turn FROM r WHERE page_type IS NOT NULL AND nth = 1 AND rank > 5),
z AS (SELECT site, count(*) AS size, count(*) FILTER (NOT is_first) AS removable FROM t GROUP BY site),
a AS (SELECT m.* FROM m JOIN z USING (site) WHERE turn <= removable + greatest(0, 5 - size)),
l AS (SELECT a.site, greatest(0, count(*) - any_value(greatest(0, 5 - size))) AS losses FROM a JOIN z USING (site) GROUP BY a.site),
k AS (SELECT t.*, row_number() OVER (PARTITION BY site, is_first ORDER BY rank DESC) AS low FROM t)
SELECT site, url, depth, priority_score, page_type, row_number() OVER (PARTITION BY site ORDER BY priority_score DESC, depth, url)::INT AS place FROM (
  SELECT k.site, url, depth, priority_score, page_type FROM k LEFT JOIN l USING (site) WHERE is_first OR low > coalesce(losses, 0) UNION ALL SELECT site, url, depth, priority_score, page_type FROM a)"""


@query(f"WITH {_RANKED}")
def critical_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = discovery.prioritized(discovery.merge_sources(_found(spark, sf_dir)))
    return discovery.covered(items, 5).select("site", "url", "depth", "priority_score", "page_type", "place")


SHOP = duck("shop_graph")


def _shop(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = fixture(spark, sf_dir, "shop_graph")
    seeds = spark.read.parquet(f"{sf_dir}/region.parquet").select(
        F.concat(F.lit("r"), "r_regionkey").alias("site"), F.concat(F.lit("https://r"), "r_regionkey", F.lit(".example.com/")).alias("url")
    )
    return seeds, edges


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT site, src, dst FROM {SHOP}), b AS (SELECT 'r' || r_regionkey AS site, 'https://r' || r_regionkey || '.example.com/' AS url, 0 AS depth FROM region
  UNION SELECT e.site, dst, depth + 1 FROM b JOIN e ON e.site = b.site AND e.src = b.url WHERE depth < 3) SELECT site, url, min(depth)::INT AS depth FROM b GROUP BY site, url""")
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds, edges = _shop(spark, sf_dir)
    return discovery.bfs(edges, seeds, 3).select("site", "url", "depth")


@query(f"""WITH e AS (SELECT DISTINCT site, src, dst FROM {SHOP}), s AS (SELECT 'r' || r_regionkey AS site, 'https://r' || r_regionkey || '.example.com/' AS url FROM region),
l1 AS (SELECT e.site, dst AS url, e.src AS parent, row_number() OVER (PARTITION BY e.site ORDER BY dst) + 1 AS place FROM e JOIN s ON e.site = s.site AND e.src = s.url WHERE dst <> s.url),
l2 AS (SELECT site, url, parent, row_number() OVER (PARTITION BY site ORDER BY turn, url) + n AS place FROM (
  SELECT e.site, dst AS url, arg_min(l1.url, l1.place) AS parent, min(l1.place) AS turn FROM e JOIN l1 ON e.site = l1.site AND e.src = l1.url WHERE dst NOT IN (SELECT url FROM s) AND dst NOT IN (SELECT url FROM l1) GROUP BY e.site, dst)
  JOIN (SELECT site, count(*) + 1 AS n FROM l1 GROUP BY site) USING (site))
SELECT site, url, 0 AS depth, NULL AS parent, 1 AS place FROM s UNION ALL SELECT site, url, 1, parent, place::INT FROM l1 WHERE place <= 40 UNION ALL SELECT site, url, 2, parent, place::INT FROM l2 WHERE place <= 40""")
def bfs_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds, edges = _shop(spark, sf_dir)
    return discovery.bfs(edges, seeds, 2, 40)


@query(f"""SELECT site, url, page_type, rank, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY rank, url) AS place FROM (
  SELECT DISTINCT site, dst AS url, {q.page_type('dst', 'text', 'in_nav', 'in_header_footer')} AS page_type, {q.tier(q.page_type('dst', 'text', 'in_nav', 'in_header_footer'))} AS rank FROM {SHOP} WHERE NOT in_header_footer)) WHERE place <= 8""")
def frontier_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = fixture(spark, sf_dir, "shop_graph").where("not in_header_footer")
    kind = links.page_class(F.col("dst"), F.col("text"), F.col("in_nav"), F.col("in_header_footer"))["page_type"]
    rows = edges.select("site", F.col("dst").alias("url"), kind.alias("page_type")).distinct()
    zero = F.lit(0)
    queue = rows.withColumns({"rank": crawl.rank(F.col("page_type"), zero), "depth": zero, "wave": zero, "page_no": zero, "tier": zero, "key": F.col("url")})
    place = F.row_number().over(Window.partitionBy("site").orderBy("rank", "url"))
    return crawl.next_in_queue(queue, F.lit(8)).withColumn("place", place).select("site", "url", "page_type", "rank", "place")


# sitemaps -----------------------------------------------------------------------

CAT = duck("catalog_urls")


def _robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = fixture(spark, sf_dir, "catalog_urls").select("site").distinct()
    n = F.regexp_extract("site", "^s([0-9]+)", 1).cast("int")
    lines = F.concat_ws(
        "\n", F.lit("# rules"), F.lit("User-agent: *"), F.lit("Disallow: /info-1"), F.lit("Disallow:"), F.lit("User-Agent: somebody"), F.lit("Disallow: /product"),
        F.when(n % 2 == 0, "Sitemap: /maps/index.xml"), F.when(n % 2 == 0, "sitemap: https://elsewhere.example/x.xml"),
    )
    return sites.select(F.concat(F.lit("https://"), "site").alias("site"), lines.alias("text"))


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "catalog_urls")
    origin = F.concat(F.lit("https://"), "site")
    priority = F.when(F.col("pos") % 3 != 0, F.concat(F.lit("<priority>"), (F.col("pos") % 10).cast("double") / 10, F.lit("</priority>"))).otherwise("")
    node = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc>"), priority, F.lit("</url>"))
    n = F.regexp_extract("site", "^s([0-9]+)", 1).cast("int")
    body = rows.groupBy("site").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("pos", node.alias("x")))), lambda s: s["x"])).alias("x"))
    head = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    sets = body.select(F.concat(origin, F.when(n % 2 == 0, "/maps/a.xml").otherwise("/sitemap.xml")).alias("url"), F.concat(F.lit(head), "x", F.lit("<url><loc>https://other.example/</loc></url></urlset>")).alias("xml"))
    index = body.select(F.concat(origin, F.lit("/maps/index.xml")).alias("url"), F.lit("<sitemapindex><sitemap><loc>a.xml</loc></sitemap><sitemap><loc>/maps/bad.xml</loc></sitemap><sitemap><loc>index.xml</loc></sitemap></sitemapindex>").alias("xml"))
    bad = body.select(F.concat(origin, F.lit("/maps/bad.xml")).alias("url"), F.lit("<urlset><url><loc>https://s0.example.com/lost</loc>").alias("xml"))
    return sets.unionByName(index).unionByName(bad)


@query(f"SELECT DISTINCT 'https://' || site AS site, '/info-1' AS prefix FROM {CAT}")
def robots_disallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitemaps.disallowed_prefixes(_robots(spark, sf_dir))


@query(f"SELECT 'https://' || site AS site, url FROM {CAT} WHERE NOT starts_with({q.path('url')}, '/info-1')")
def robots_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "catalog_urls").select(F.concat(F.lit("https://"), "site").alias("site"), "url")
    return sitemaps.allowed(rows, sitemaps.disallowed_prefixes(_robots(spark, sf_dir)))


def _locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    robots = _robots(spark, sf_dir)
    return sitemaps.sitemap_locations(robots.select("site", F.col("site").alias("origin")), robots)


@query(f"""SELECT site, u AS sitemap_url FROM (SELECT DISTINCT 'https://' || site AS site, regexp_extract(site, '^s([0-9]+)', 1)::INT AS n FROM {CAT}),
  LATERAL (SELECT unnest(CASE WHEN n % 2 = 0 THEN [site || '/maps/index.xml', 'https://elsewhere.example/x.xml'] ELSE [site || '/sitemap.xml', site || '/sitemap_index.xml', site || '/sitemap-index.xml', site || '/sitemaps/sitemap.xml'] END) AS u)""")
def sitemap_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _locations(spark, sf_dir).select("site", "sitemap_url")


@query(f"""SELECT site, url, priority, changefreq, depth, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY priority DESC, depth, url) AS place FROM (
  SELECT 'https://' || site AS site, {q.normalize('url')} AS url, max(least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN pos % 3 <> 0 THEN (pos % 10)::DOUBLE / 10 ELSE 0.5::DOUBLE END) + {q.boost('url')})) AS priority, 'unknown' AS changefreq, any_value(len({q.segments(q.path('url'))}))::INT AS depth
  FROM {CAT} WHERE NOT starts_with({q.path('url')}, '/info-1') GROUP BY 1, 2)) WHERE place <= 200""")
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = sitemaps.disallowed_prefixes(_robots(spark, sf_dir))
    return sitemaps.sitemap_urls(_locations(spark, sf_dir), _maps(spark, sf_dir), closed).drop("lastmod")


# crawls -------------------------------------------------------------------------


def _crawl_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    seeds, edges = _shop(spark, sf_dir)
    out = edges.select(F.col("src").alias("url"), F.col("dst").alias("href"), "text", "in_nav", "in_header_footer")
    # every eleventh customer page fails, and pages take as long as their number says
    c = fixture(spark, sf_dir, "shop_graph").select(F.col("dst").alias("url")).distinct()
    n = F.coalesce(F.nullif(F.regexp_extract("url", "([0-9]+)$", 1), F.lit("")).cast("long"), F.lit(0))
    bad = F.col("url").contains("/customer/") & (n % 11 == 3)
    pages = c.select(
        "url",
        F.when(bad, "error").otherwise("success").alias("fetch_status"),
        F.when(bad, F.when(n % 2 == 0, "request timed out").otherwise("lxml parser failed")).alias("failure_reason"),
        ((n % 7).cast("double") / 2).alias("duration_s"),
        F.array(F.concat(F.lit("title:"), F.col("url"))).alias("signals"),
    )
    return seeds.withColumnRenamed("url", "seed_url"), pages, out


@query()
def crawl_sim_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.crawl(*_crawl_inputs(spark, sf_dir), crawl.CrawlConfig(max_pages=12))[0]


@query()
def crawl_sim_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.crawl(*_crawl_inputs(spark, sf_dir), crawl.CrawlConfig(max_pages=12))[1]


@query()
def crawl_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.recommend_targets(*_crawl_inputs(spark, sf_dir), budget=8)


@query()
def crawl_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the adaptive crawl against a plain one with the same budget."""
    seeds, pages, out = _crawl_inputs(spark, sf_dir)
    smart, seen = crawl.crawl(seeds, pages, out, crawl.CrawlConfig(max_pages=10))
    base, base_seen = crawl.blind_bfs(seeds, pages, out, 10)
    tpl = lambda rows, name: rows.groupBy("site").agg(F.count_distinct(urls.template_signal(F.col("url"))).alias(name))
    runs = smart.select("site", F.col("pages_crawled").alias("pages"), F.col("crawl_duration_s").alias("s"))
    runs = runs.join(base.select("site", F.col("pages_crawled").alias("base_pages"), F.col("crawl_duration_s").alias("base_s")), "site")
    return scoring.reduction_report(runs.join(tpl(seen, "templates"), "site").join(tpl(base_seen, "base_templates"), "site"))


# states -------------------------------------------------------------------------

_STATES = duck("dom_states")
_LINKS = f"""(SELECT site, state_seq, state_label, hash, url, pos FROM (SELECT site, state_seq, state_label, hash, pos, {q.normalize(q.resolve("('https://' || site || '/')", 'href'))} AS url FROM (
  SELECT site, state_seq, state_label, hash, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS pos FROM (
    SELECT *, substr(sha256(html), 1, 16) AS hash, row_number() OVER (PARTITION BY site, sha256(html) ORDER BY state_seq) AS r FROM {_STATES}) WHERE r = 1)))"""
_STATE_LINKS = f"""SELECT site, url, state_label, hash AS dom_hash, state_seq::INT AS state_seq FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY state_seq, pos) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY state_seq, pos) AS k FROM {_LINKS}) WHERE k = 1) WHERE n <= 50"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "dom_states")
    return rows.select("site", F.concat(F.lit("https://"), "site", F.lit("/")).alias("seed_url"), "state_seq", "state_label", "html", html.hrefs(F.col("html")).alias("links"))


@query(_STATE_LINKS)
def dom_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.state_links(_states(spark, sf_dir))


@query(f"""WITH a AS (SELECT s.site, s.state_seq, coalesce(n, 0) AS added FROM {_STATES} s LEFT JOIN (SELECT site, state_seq, count(*) AS n FROM ({_STATE_LINKS}) GROUP BY ALL) c ON c.site = s.site AND c.state_seq = s.state_seq WHERE s.state_seq <= 6),
b AS (SELECT *, sum(added) OVER (PARTITION BY site ORDER BY state_seq) AS cum FROM a), e AS (SELECT *, coalesce(min(state_seq) FILTER (state_seq - 1 >= 2 AND cum = 0) OVER (PARTITION BY site), 6) AS stop FROM b),
g AS (SELECT site, count(*) - 1 AS actions, count(*) FILTER (added > 0) AS fresh FROM e WHERE state_seq <= stop GROUP BY site)
SELECT site, actions::BIGINT AS actions_taken, fresh::BIGINT AS new_states, CASE WHEN actions > 0 THEN round(fresh / actions, 2) ELSE 0.0::DOUBLE END AS dom_change_ratio, actions >= 2 AND fresh = 0 AS early_stopped FROM g""")
def dom_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _states(spark, sf_dir)
    return discovery.exploration_quality(states, discovery.state_links(states))


@query("""SELECT page_id AS page, kind, seq::INT AS seq FROM (SELECT page_id, kind, s AS seq, row_number() OVER (PARTITION BY page_id, kind ORDER BY s) AS n, fits FROM (
  SELECT page_id, s, kind, fits FROM (SELECT page_id, unnest(l) AS text, unnest(range(1, len(l) + 1)) AS s FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS l FROM pages)),
  LATERAL (SELECT 'nav_hover' AS kind, TRUE AS fits UNION ALL SELECT 'route_change', TRUE UNION ALL SELECT 'load_more', regexp_matches(lower(text), 'load more|show more|next|more') UNION ALL SELECT 'modal', regexp_matches(lower(text), 'modal|popup|dialog|overlay')))) WHERE n <= 10 AND fits""")
def interaction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.page_links(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    none = F.lit(None).cast("string")
    elements = found.select(
        F.col("page_id").alias("page"), (F.col("pos") + 1).alias("seq"), F.lit("a").alias("tag"), none.alias("role"), "text", "href", "in_nav",
        F.lit(False).alias("in_header"), none.alias("aria_label"), none.alias("aria_haspopup"), none.alias("aria_controls"),
    )
    return discovery.candidates(elements)


# sessions -----------------------------------------------------------------------

_SLOG = f"(SELECT 'https://u' || site || '.example.com/' || (event_id % 50) AS fetch_url, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'failed:engine_error' END AS status, event_id AS seq FROM (SELECT user_id AS site, event_id FROM events))"
_SLAST = f"(SELECT fetch_url, arg_max(status, seq) AS status, max(seq) AS seq FROM {_SLOG} GROUP BY fetch_url)"


def _status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    status = F.when(i % 4 == 0, "pending").when(i % 4 == 1, "processing").when(i % 4 == 2, "completed").otherwise("failed:engine_error")
    url = F.concat(F.lit("https://u"), "user_id", F.lit(".example.com/"), i % 50)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(url.alias("fetch_url"), status.alias("status"), i.alias("seq"), "value")


def _queue(log: DataFrame) -> DataFrame:
    return log.select("fetch_url", urls.dedup_key(F.col("fetch_url")).alias("dedup_key")).distinct()


@query(f"SELECT fetch_url, fetch_url AS dedup_key FROM {_SLAST} WHERE status = 'pending'")
def session_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _status_log(spark, sf_dir)
    return store.pending(_queue(log), log)


@query(f"SELECT DISTINCT fetch_url AS dedup_key FROM {_SLAST} WHERE status <> 'pending'")
def session_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _status_log(spark, sf_dir)
    return store.seen_keys(_queue(log), log)


@query("""SELECT 'https://u' || user_id || '.example.com/' || (event_id % 50) AS url, arg_max('{"event":' || event_id || ',"kind":"' || event_type || '"}', event_id) AS data FROM events GROUP BY 1""")
def result_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    url = F.concat(F.lit("https://u"), "user_id", F.lit(".example.com/"), F.col("event_id") % 50)
    data = F.to_json(F.struct(F.col("event_id").alias("event"), F.col("event_type").alias("kind")))
    return store.latest(rows.select(url.alias("url"), data.alias("data"), F.col("event_id").alias("seq")), "url", "data")


# reports ------------------------------------------------------------------------

_NODE = lambda u: f"'node_' || substr(md5({u}), 1, 12)"
_RESULTS = f"(SELECT dst AS url, {q.page_type('dst', 'text', 'in_nav', 'in_header_footer')} AS page_type, src AS parent_url FROM {SHOP} WHERE NOT in_header_footer)"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = links.page_class(F.col("dst"), F.col("text"), F.col("in_nav"), F.col("in_header_footer"))["page_type"]
    return fixture(spark, sf_dir, "shop_graph").where("not in_header_footer").select(F.col("dst").alias("url"), kind.alias("page_type"), F.col("src").alias("parent_url"))


@query(f"""SELECT DISTINCT {_NODE('url')} AS node, CASE WHEN length(c) > 30 THEN '...' || right(c, 27) ELSE c END AS label, page_type, url FROM (SELECT *, trim(replace(replace(url, 'https://', ''), 'http://', ''), '/') AS c FROM {_RESULTS})""")
def mermaid_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.nodes(_results(spark, sf_dir))


@query(f"SELECT DISTINCT {_NODE('parent_url')} AS parent, {_NODE('url')} AS child FROM {_RESULTS} WHERE parent_url <> url AND parent_url IN (SELECT url FROM {_RESULTS})")
def mermaid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.edges(_results(spark, sf_dir))


@query(f"SELECT url, page_type, CASE WHEN contains(url, '/order/') THEN TRUE ELSE FALSE END AS js_required, parent_url, 'thin' AS topology, CASE WHEN contains(url, '/order/') THEN 'playwright' ELSE 'fetch' END AS engine FROM {_RESULTS}")
def extraction_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    js = F.when(F.col("url").contains("/order/"), True)
    rows = report.jobs(_results(spark, sf_dir).withColumn("js_required", js).withColumn("topology", F.lit("thin")))
    return rows.select("url", "metadata.*", "engine")


@query(f"""SELECT kind, count(*)::BIGINT AS pages, round(100 * count(*) / sum(count(*)) OVER (), 2) AS share FROM (SELECT {q.page_type('dst', 'text', 'in_nav', 'in_header_footer')} AS kind FROM {SHOP}) GROUP BY kind""")
def page_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = links.page_class(F.col("dst"), F.col("text"), F.col("in_nav"), F.col("in_header_footer"))["page_type"]
    counts = fixture(spark, sf_dir, "shop_graph").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("pages"))
    return counts.withColumn("share", F.round(100 * F.col("pages") / F.sum("pages").over(Window.partitionBy()), 2))


# streams ------------------------------------------------------------------------


def _kept(spark: SparkSession) -> str:
    return f"{own_dir(spark)}/out-{uuid.uuid4().hex}"


@query("SELECT time_bucket(INTERVAL 10 MINUTES, ts) AS start, count(*)::BIGINT AS failures FROM events WHERE event_type = 'error' GROUP BY 1")
def stream_failure_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _kept(spark)
    windows = jobs.failure_windows(jobs.events_stream(spark, sf_dir))
    jobs.run_once(windows, lambda batch, n: batch.write.mode("overwrite").parquet(place), "complete")
    return spark.read.parquet(place).select(F.col("start").cast("timestamp_ntz").alias("start"), "failures")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _kept(spark)
    rows = jobs.events_stream(spark, sf_dir).withColumn("key", F.concat_ws("/", "user_id", "event_type"))
    jobs.run_once(jobs.distinct_keys(rows, "key"), lambda batch, n: batch.write.mode("overwrite").parquet(f"{place}/{n}"))
    return spark.read.option("recursiveFileLookup", "true").parquet(place).select("user_id", "event_type")


@query("""SELECT round(avg((event_type = 'error')::INT), 6) AS timeout_rate, round(avg((event_id % 10 = 0)::INT), 6) AS degraded_rate, round(avg((event_id % 5)::DOUBLE / 10), 6) AS enrichment_fallback_rate
  FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)""")
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = jobs.events_stream(spark, sf_dir).select(
        "event_id", "ts", (F.col("event_type") == "error").alias("timeout"), (i % 10 == 0).alias("degraded_mode"), ((i % 5).cast("double") / 10).alias("fallback_rate")
    )
    alerts = jobs.RollingAlerts(spark)
    jobs.run_once(rows, alerts.write)
    return alerts.snapshot()


@query(f"SELECT DISTINCT site, stop_ord FROM ({INFO_GAIN}) WHERE stop_ord IS NOT NULL")
def stream_info_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _kept(spark)
    log = _kept(spark)
    fixture(spark, sf_dir, "crawl_log").select("site", F.col("ord").cast("int").alias("ord"), "fetch_status", "signal").write.parquet(log)
    stream = spark.readStream.schema(spark.read.parquet(log).schema).parquet(log)
    jobs.run_once(jobs.info_gain_stops(stream), lambda batch, n: batch.write.mode("overwrite").parquet(f"{place}/{n}"))
    return spark.read.option("recursiveFileLookup", "true").schema(jobs.GAIN_OUT).parquet(place)



# events and choices -------------------------------------------------------------


@query("""SELECT page_id AS page, tier::INT AS tier, min(pos)::INT AS seq FROM (SELECT page_id, pos, text, CASE WHEN regexp_matches(lower(text), 'accept|consent') THEN 0 ELSE 1 END AS tier FROM (
  SELECT page_id, unnest(range(5)) AS pos, unnest(['Read more', 'Accept all cookies', 'OK', 'ok, privacy', 'Accept']) AS text FROM pages WHERE page_id % 2 = 0)) WHERE tier = 1 AND regexp_matches(lower(text), 'cookie|consent|privacy') GROUP BY ALL
  UNION ALL SELECT page_id, 2, 1 FROM pages WHERE page_id % 2 = 1""")
def cookie_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("page"))
    texts = ["Read more", "Accept all cookies", "OK", "ok, privacy", "Accept"]
    even = pages.where("page % 2 = 0").select("page", F.posexplode(F.array(*map(F.lit, texts))).alias("seq", "text"))
    # what only accepts is not clickable here, so a text that speaks of privacy is left
    even = even.select("page", F.lit(1).alias("tier"), "seq", "text", F.lit(None).cast("string").alias("aria_label"), (~F.lower("text").rlike("accept|consent")).alias("clickable"))
    odd = pages.where("page % 2 = 1").select(
        "page", F.lit(2).alias("tier"), F.posexplode(F.array(F.lit("menu"), F.lit("Accept cookies"))).alias("seq", "aria_label"), F.lit("").alias("text"), F.lit(True).alias("clickable")
    )
    return events.cookie_choice(even.unionByName(odd))


@query(f"""SELECT url AS seed, CASE WHEN page_id % 3 = 0 THEN base || '/explore' WHEN page_id % 3 = 1 THEN base || '/features' END AS url, CASE page_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'partial' ELSE 'none' END AS kind
  FROM (SELECT page_id, url, {q.scheme('url')} || '://' || {q.authority('url')} AS base FROM pages)""")
def public_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = events.fallback_candidates(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    wall = F.lit("<form action='/login'><input type='password'> please sign in </form>")
    text = (
        F.when(F.col("page_id") % 3 == 2, "short")
        .when((F.col("page_id") % 3 == 1) & (F.col("pos") < 3), wall)
        .when((F.col("page_id") % 3 == 0) & (F.col("pos") == 0), wall)
        .when(F.col("page_id") % 3 == 0, "<main>a public page with enough text to be worth a look</main>")
    )
    # each page is a scan of its own: URLs repeat in larger tables
    return events.public_fallback(tries.withColumn("html", text), ("page_id", "seed")).drop("page_id")


@query(f"""SELECT site, count(*)::BIGINT AS requests, count(*) FILTER (page_id % 7 = 0)::BIGINT AS failed, count(*) FILTER (page_id % 14 = 0)::BIGINT AS blocked,
  coalesce(sum(strlen(html)) FILTER (page_id % 7 <> 0), 0)::BIGINT AS bytes, count(DISTINCT {q.template_signal('url')})::BIGINT AS templates FROM (SELECT *, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS site FROM pages) GROUP BY site""")
def bfs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    i = F.col("page_id")
    status = F.when(i % 14 == 0, 503).when(i % 7 == 0, 404).otherwise(200)
    # each page row is a request of its own: URLs repeat in larger tables
    return events.bfs_baseline(pages.select(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("site"), "url", status.alias("status"), "html"))


@query("""SELECT page_id, CASE WHEN html LIKE '%|%' THEN NULL ELSE left(regexp_extract(html, '<h1>([^<]*)</h1>', 1), 12) END AS result FROM pages""")
def post_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's function over pages; it fails on pages with a bar, whose result is null."""

    def title(text: str) -> str:
        if "|" in text:
            raise ValueError("bar")
        return text.split("<h1>")[1].split("<")[0][:12]

    return events.with_post_process(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), title).select("page_id", "result")


@query()
def crawl_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.crawl_events(*crawl.crawl(*_crawl_inputs(spark, sf_dir), crawl.CrawlConfig(max_pages=5)))
