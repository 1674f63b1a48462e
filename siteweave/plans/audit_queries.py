"""Failure, request, score, telemetry and stop-rule queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import failures, requests, rules, urls
from ..operators import scoring, stop_rules, telemetry
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


# failures ---------------------------------------------------------------------

_T = "lower(trim(raw))"
_BLOCKS = "(src <> '' AND NOT contains(src, '''unsafe-inline''') AND NOT contains(src, 'nonce-') AND NOT contains(src, 'sha256-'))"
_SRC = "coalesce(list_filter(ds, lambda d: regexp_matches(d, '^script-src(\\s|$)'))[-1], list_filter(ds, lambda d: regexp_matches(d, '^default-src(\\s|$)'))[-1], '')"
_DIRECTIVES = f"(SELECT *, {_SRC} AS src FROM (SELECT *, list_filter(list_transform(string_split(csp, ';'), lambda x: lower(trim(x))), lambda y: y <> '') AS ds FROM {duck('failures')}))"
_ALIASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.REASON_ALIASES.items())
_REASON = f"""CASE WHEN {_T} IN ({', '.join(map(q.text, rules.REASONS))}) THEN {_T} WHEN {_T} IN ({', '.join(map(q.text, rules.REASON_ALIASES))}) THEN CASE {_T} {_ALIASES} END
  WHEN http_status = 429 OR contains({_T}, 'status code 429') THEN 'rate_limited' WHEN http_status = 403 OR {q.any_of(_T, rules.CAPTCHA_TOKENS)} THEN 'bot_wall'
  WHEN {_BLOCKS} THEN 'csp_blocked' WHEN {q.any_of(_T, rules.CSP_TOKENS)} THEN 'csp_injection_blocked' WHEN {q.any_of(_T, rules.CONNECT_TOKENS)} THEN 'connectivity_blocked'
  WHEN {q.any_of(_T, rules.NAVIGATION_TOKENS)} THEN 'browser_navigation_failed' WHEN {q.any_of(_T, rules.TIMEOUT_TOKENS)} THEN 'render_timeout'
  WHEN {q.any_of(_T, rules.EXTRACTION_TOKENS)} THEN 'extraction_failed' WHEN http_status >= 500 THEN 'connectivity_blocked' WHEN http_status >= 400 THEN 'bot_wall' ELSE 'engine_error' END"""
_ACTION = "CASE reason " + " ".join(f"WHEN '{k}' THEN '{rules.ADAPTIVE_ACTIONS[v]}'" for k, v in rules.FAILURE_ACTIONS.items()) + " END"
_SEVERITY = "CASE reason " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in rules.FAILURE_SEVERITY.items()) + " END"
_MESSAGE = "CASE reason " + " ".join(f"WHEN '{k}' THEN {q.text(v)}" for k, v in rules.REASON_MESSAGES.items()) + " END"


def _reason():
    return failures.normalize_failure(F.col("raw"), F.col("http_status"), F.col("csp"))


@query(f"SELECT id, {_REASON} AS reason FROM {_DIRECTIVES}")
def failure_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "failures").select("id", _reason().alias("reason"))


@query(f"SELECT id, reason, {_ACTION} AS action, {_SEVERITY} AS severity, {_MESSAGE} || coalesce(' (' || http_status || ')', '') AS message FROM (SELECT id, http_status, {_REASON} AS reason FROM {_DIRECTIVES})")
def failure_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "failures").withColumn("reason", _reason())
    r = F.col("reason")
    return rows.select(
        "id", "reason", failures.adaptive_action(r).alias("action"), failures.failure_severity(r).alias("severity"), failures.reason_message(r, F.col("http_status").cast("string")).alias("message")
    )


@query(f"SELECT id, {_BLOCKS} AS blocks FROM {_DIRECTIVES}")
def csp_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "failures").select("id", failures.csp_blocks_inline(F.col("csp")).alias("blocks"))


@query(f"SELECT reason, count(*)::BIGINT AS n FROM (SELECT {_REASON} AS reason FROM {_DIRECTIVES}) GROUP BY reason")
def failure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "failures").groupBy(_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# requests ---------------------------------------------------------------------

_P, _Q, _H = f"lower({q.path('url')})", f"lower({q.query('url')})", q.host("url")
_SCORE = f"""(CASE WHEN {q.any_of(_H, rules.HEAVY_HOSTS)} THEN 2 ELSE 0 END + CASE WHEN {q.any_of(_P, rules.HEAVY_PATHS)} THEN 2 WHEN {q.any_of(_P, rules.MODERATE_PATHS)} THEN 1 ELSE 0 END
  + CASE WHEN {_Q} <> '' THEN 1 ELSE 0 END + CASE WHEN length({_Q}) > 64 THEN 1 ELSE 0 END + CASE WHEN len({q.segments(_P)}) >= 4 THEN 1 ELSE 0 END
  + CASE WHEN contains(url, '?') AND contains(lower(url), 'utm_') THEN 1 ELSE 0 END)"""
_COMPLEXITY = f"CASE WHEN {_SCORE} >= 4 THEN 'heavy' WHEN {_SCORE} >= 2 THEN 'moderate' ELSE 'simple' END"
_MODES = "CASE id % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'deep' ELSE 'max' END"
_MULT = "CASE " + " ".join(f"WHEN mode = '{m}' AND complexity = '{c}' THEN {v}::DOUBLE" for m, t in rules.PAGE_MULTIPLIERS.items() for c, v in t.items()) + " END"
_IO = "CASE complexity " + " ".join(f"WHEN '{c}' THEN {v}::DOUBLE" for c, v in rules.IO_MULTIPLIERS.items()) + " END"
_LOW = "CASE mode " + " ".join(f"WHEN '{m}' THEN {v[0]}" for m, v in rules.PAGE_TIMEOUTS.items()) + " END"
_HIGH = "CASE mode " + " ".join(f"WHEN '{m}' THEN {v[1]}" for m, v in rules.PAGE_TIMEOUTS.items()) + " END"


def _mode():
    return F.when(F.col("id") % 3 == 0, "fast").when(F.col("id") % 3 == 1, "deep").otherwise("max")


@query(f"SELECT id, {_COMPLEXITY} AS complexity FROM {duck('all_urls')}")
def page_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "all_urls").select("id", requests.page_complexity(F.col("url")).alias("complexity"))


@query(f"""SELECT id, complexity, greatest({_LOW}, least({_HIGH}, round_even(15 * {_MULT}, 0)))::INT AS page_timeout_seconds,
  greatest(2500, least(22000, round_even(9000 * {_IO}, 0)))::INT AS network_idle_timeout_ms, greatest(2000, least(12000, round_even(2750 * {_IO}, 0)))::INT AS ready_state_timeout_ms
  FROM (SELECT id, {_MODES} AS mode, {_COMPLEXITY} AS complexity FROM {duck('all_urls')})""")
def adaptive_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "all_urls")
    t = requests.adaptive_timeouts(F.col("url"), _mode(), F.lit(15), F.lit(9000), F.lit(2750))
    return rows.select("id", t.alias("t")).select("id", "t.*")


_HEX = f"('0x' || substr(sha256({_H}), 1, 8))::BIGINT"


@query(f"""SELECT id, (({_HEX} % 4 + id % 3) % 4)::INT AS agent, (400 + {_HEX} % 801)::INT AS delay_ms FROM {duck('all_urls')}""")
def user_agent_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return fixture(spark, sf_dir, "all_urls").select("id", requests.user_agent_index(u, F.col("id") % 3).alias("agent"), requests.delay_ms(u).alias("delay_ms"))


_RH, _SH, _K = q.host("request_url"), q.host("seed_url"), "lower(resource_type)"
_THIRD = f"({_RH} <> '' AND {_SH} <> '' AND {_RH} <> {_SH} AND NOT ends_with({_RH}, '.' || {_SH}))"
_TRACK = q.any_of(_RH, rules.TRACKER_HOSTS)
_OTHERS = [h for h in rules.TRACKER_HOSTS if h != "facebook.com"]
_LISTED = f"({_RH} IN ({', '.join(map(q.text, rules.WHITELIST_HOSTS))}) OR ends_with({_RH}, '.cloudfront.net'))"
_BLOCK3 = f"({_K} = 'script' AND {_THIRD} AND NOT {_LISTED} AND CASE WHEN contains({_RH}, 'facebook.com') THEN contains(lower(request_url), '/tr') ELSE {q.any_of(_RH, _OTHERS)} END)"
_BLOCKP = f"""CASE WHEN {_K} IN ('image', 'font', 'media') THEN TRUE WHEN {_K} = 'script' THEN {_BLOCK3} OR ({_THIRD} AND ({_TRACK} OR {q.any_of('lower(request_url)', rules.BLOCKED_URL_TOKENS)}))
  WHEN {_K} IN ('xhr', 'fetch') THEN {_THIRD} AND {_TRACK} ELSE FALSE END"""


@query(f"SELECT id, {_BLOCK3} AS third_party, {_BLOCKP} AS blocked FROM {duck('requests')}")
def request_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = (F.col("request_url"), F.col("seed_url"), F.col("resource_type"))
    return fixture(spark, sf_dir, "requests").select(
        "id", requests.blocks_third_party(*args).alias("third_party"), requests.blocks_for_performance(*args).alias("blocked")
    )


@query(f"SELECT CASE WHEN {_K} IN ('image', 'font', 'media', 'script', 'xhr', 'fetch') THEN {_K} ELSE 'other' END AS bucket, count(*)::BIGINT AS requests, count(*) FILTER ({_BLOCKP})::BIGINT AS blocked FROM {duck('requests')} GROUP BY 1")
def blocked_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = requests.blocks_for_performance(F.col("request_url"), F.col("seed_url"), F.col("resource_type"))
    bucket = requests.request_bucket(F.col("resource_type")).alias("bucket")
    return fixture(spark, sf_dir, "requests").groupBy(bucket).agg(F.count(F.lit(1)).alias("requests"), F.count_if(blocked).alias("blocked"))


@query(f"SELECT id, n::INT AS n, {q.scheme('url')} || '://' || {q.authority('url')} || '/' || p AS url FROM {duck('all_urls')}, (VALUES (0, 'about'), (1, 'explore'), (2, 'features'), (3, 'pricing')) v(n, p)")
def fallback_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "all_urls")
    return rows.select("id", F.posexplode(requests.fallback_urls(F.col("url"))).alias("n", "url"))


# scores -------------------------------------------------------------------------

SIG = duck("page_signals")
_SEV = "CASE lower(coalesce(severity, 'minor')) WHEN 'critical' THEN 'critical' WHEN 'major' THEN 'major' WHEN 'serious' THEN 'major' ELSE 'minor' END"
_BUCKET = "CASE WHEN enrichment_source = 'fix_library_cache' THEN 'fix_cache' WHEN starts_with(enrichment_source, 'rule_fallback') THEN 'rule_fallback' WHEN enrichment_source IN ('llm', 'llm_cache', 'fix_cache') THEN enrichment_source ELSE 'other' END"
_ISSUES = f"SELECT site, type, location, f.s AS severity, f.page_pos AS affected_page, n FROM (SELECT site, type, selector AS location, min({{'page_pos': page_pos, 'sig_pos': sig_pos, 's': coalesce(severity, 'minor')}}) AS f, count(*)::BIGINT AS n FROM {SIG} GROUP BY site, type, selector)"


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "page_signals")


@query(_ISSUES)
def site_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.site_issues(_signals(spark, sf_dir))


@query(f"SELECT site, sum(n)::BIGINT AS signals_before, count(*)::BIGINT AS signals_after FROM ({_ISSUES}) GROUP BY site")
def site_issue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.issue_totals(scoring.site_issues(_signals(spark, sf_dir)))


@query(f"SELECT site, round(avg(CASE WHEN audit_status = 'success' THEN 100.0::DOUBLE ELSE 0 END), 2) AS score FROM {duck('page_scores')} GROUP BY site")
def site_score_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.success_score(fixture(spark, sf_dir, "page_scores"))


@query(f"""SELECT s.site, round(greatest(t / w - least(2 * coalesce(c, 0), 20), 0), 1) AS score FROM (
  SELECT site, sum(score * w0) FILTER (audit_status = 'success') AS t, sum(w0) FILTER (audit_status = 'success') AS w FROM (
    SELECT *, CASE WHEN coalesce(page_weight, 0) = 0 THEN 0.7::DOUBLE ELSE page_weight::DOUBLE END AS w0 FROM {duck('page_scores')}) GROUP BY site) s
  LEFT JOIN (SELECT site, count(*) FILTER (severity = 'critical') AS c FROM ({_ISSUES}) GROUP BY site) i ON i.site = s.site""")
def site_score_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.weighted_score(fixture(spark, sf_dir, "page_scores"), scoring.site_issues(_signals(spark, sf_dir)))


@query(f"SELECT site, count(*) FILTER ({_SEV} = 'critical')::BIGINT AS critical, count(*) FILTER ({_SEV} = 'major')::BIGINT AS major, count(*) FILTER ({_SEV} = 'minor')::BIGINT AS minor FROM {SIG} GROUP BY site")
def severity_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.severity_breakdown(_signals(spark, sf_dir))


@query("SELECT site, " + ", ".join(f"count(*) FILTER ({_BUCKET} = '{b}')::BIGINT AS {b}" for b in [*scoring.ENRICHMENT, "other"]) + f", round(count(*) FILTER ({_BUCKET} = 'rule_fallback') / count(*), 6) AS fallback_rate FROM {SIG} GROUP BY site")
def enrichment_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.enrichment_breakdown(_signals(spark, sf_dir))


@query(f"SELECT site, round(min(priority_score), 3) AS min, round(quantile_cont(priority_score, 0.5), 3) AS p50, round(quantile_cont(priority_score, 0.95), 3) AS p95, round(max(priority_score), 3) AS max, round(avg(priority_score), 3) AS avg FROM {SIG} GROUP BY site")
def priority_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.priority_distribution(_signals(spark, sf_dir))


@query(f"SELECT site, issue_type, n::BIGINT AS count, r::INT AS rank FROM (SELECT site, type AS issue_type, count(*) AS n, row_number() OVER (PARTITION BY site ORDER BY count(*) DESC, type) AS r FROM {SIG} GROUP BY site, type) WHERE r <= 5")
def top_issue_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.top_issue_types(_signals(spark, sf_dir))


# telemetry ----------------------------------------------------------------------

EV = duck("audit_events")
_LAST = f"(SELECT * FROM {EV} ORDER BY ts DESC, event_id DESC LIMIT 1000)"


@query(f"SELECT round(avg(CASE WHEN timeout THEN 1.0::DOUBLE ELSE 0 END), 6) AS timeout_rate, round(avg(CASE WHEN degraded_mode THEN 1.0::DOUBLE ELSE 0 END), 6) AS degraded_rate, round(avg(fallback_rate), 6) AS enrichment_fallback_rate FROM {_LAST}")
def alert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.alert_snapshot(fixture(spark, sf_dir, "audit_events"))


_METRICS = f"""WITH e AS (SELECT * FROM {_LAST}), m AS (SELECT scan_mode AS label, quantile_cont(duration_ms, 0.5) AS a, quantile_cont(duration_ms, 0.95) AS b, quantile_cont(pages_audited, 0.5) AS c FROM e GROUP BY scan_mode)
SELECT 'audit_duration_p50_ms' AS metric, label, round(a, 6) AS value FROM m UNION ALL SELECT 'audit_duration_p95_ms', label, round(b, 6) FROM m UNION ALL SELECT 'pages_per_audit_p50', label, round(c, 6) FROM m
UNION ALL SELECT 'timeout_rate', '', round(avg(timeout::INT), 6) FROM e UNION ALL SELECT 'degraded_rate', '', round(avg(degraded_mode::INT), 6) FROM e
UNION ALL SELECT 'enrichment_fallback_rate', '', round(avg(fallback_rate), 6) FROM e UNION ALL SELECT 'enrichment_completion_rate', '', round(avg((enrichment_status = 'complete')::INT), 6) FROM e"""


_TIER = "CASE event_id % 4 WHEN 0 THEN 'page' WHEN 1 THEN 'dom' WHEN 2 THEN 'llm' ELSE 'fix' END"
_METRICS += f"""
UNION ALL SELECT 'cache_hit_rate', {_TIER}, round(count(*) FILTER (user_id % 3 <> 0) / count(*), 6) FROM events GROUP BY 2
UNION ALL SELECT 'crawler_sitemap_success_rate', '', 0.75 UNION ALL SELECT 'crawler_discovery_fallback_rate', '', 0.0"""


@query(_METRICS)
def prometheus_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    tier = F.element_at(F.array(*map(F.lit, telemetry.TIERS)), (i % 4 + 1).cast("int"))
    kind = F.when(F.col("user_id") % 3 != 0, "_hits").otherwise("_misses")
    counters = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(tier, kind).alias("name"), F.lit(1).alias("value"))
    return telemetry.metrics(fixture(spark, sf_dir, "audit_events"), counters=counters, gauges={"crawler_sitemap_success_rate": 0.75})


@query(f"SELECT event_id, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 600 SECONDS PRECEDING AND CURRENT ROW)::BIGINT AS failures FROM {EV} WHERE timeout")
def llm_failure_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.bursts(fixture(spark, sf_dir, "audit_events"), 600)


@query(f"""SELECT a.*, site_score AS shown_score, total_issues AS issue_count, critical::BIGINT AS critical_issues, major::BIGINT AS major_issues, minor::BIGINT AS minor_issues, llm, llm_cache, fix_cache, rule_fallback, other, fallback_rate AS enrichment_fallback_rate,
  d.min AS priority_min, p50 AS priority_p50, p95 AS priority_p95, d.max AS priority_max, d.avg AS priority_avg, top_issue_types FROM (
  SELECT s_suppkey AS site, 'a' || s_suppkey AS audit_id, 'audit' AS event_type, CASE WHEN s_suppkey % 9 = 0 THEN 'failed' ELSE 'completed' END AS status, 'https://s' || s_suppkey || '.example.com/' AS url,
    CASE s_suppkey % 4 WHEN 0 THEN 'fast' WHEN 1 THEN 'deep' WHEN 2 THEN 'max' ELSE 'fast' END AS scan_mode, greatest(1, s_suppkey % 7)::INT AS pages_discovered, greatest(1, s_suppkey % 5)::INT AS pages_audited,
    s_acctbal / 100 AS scan_time_seconds, trunc(s_acctbal / 100 * 1000)::BIGINT AS total_duration_ms, s_suppkey % 3 = 0 AS degraded_mode,
    s_suppkey % 10 = 0 OR s_suppkey % 4 = 1 AS timeout, (s_suppkey % 101)::DOUBLE AS site_score, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 50 <> 0 THEN (s_suppkey % 50)::DOUBLE ELSE (s_suppkey % 101)::DOUBLE END AS overall_score,
    s_suppkey % 13 AS total_issues, CASE WHEN s_suppkey % 5 = 0 THEN 'render_timeout' WHEN s_suppkey % 5 = 1 THEN 'connectivity_blocked' WHEN s_suppkey % 3 <> 0 THEN '' WHEN s_suppkey % 5 = 2 THEN 'rate_limited' ELSE 'engine_error' END AS degraded_reason,
    CASE WHEN s_suppkey % 8 = 0 THEN 'partial' ELSE 'complete' END AS enrichment_status, CASE WHEN s_suppkey % 2 = 0 THEN 'dom,rules' ELSE '' END AS engines_used,
    CASE WHEN s_suppkey % 4 = 1 THEN 'false' ELSE 'true' END AS runtime_passed, s_suppkey % 6 AS page_hits FROM supplier) a
  LEFT JOIN ({ORACLES['severity_breakdown']}) b USING (site) LEFT JOIN ({ORACLES['enrichment_breakdown']}) c USING (site) LEFT JOIN ({ORACLES['priority_distribution']}) d USING (site)
  LEFT JOIN (SELECT site, string_agg(issue_type || ':' || count, ',' ORDER BY rank) AS top_issue_types FROM ({ORACLES['top_issue_types']}) GROUP BY site) t USING (site)""")
def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    results = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        k.alias("site"),
        F.concat(F.lit("a"), k).alias("audit_id"),
        F.when(k % 9 == 0, "failed").alias("status"),
        F.concat(F.lit("https://s"), k, F.lit(".example.com/")).alias("url"),
        F.when(k % 4 == 0, "fast").when(k % 4 == 1, "deep").when(k % 4 == 2, "max").otherwise("").alias("scan_mode"),
        (k % 7).alias("pages_discovered"),
        (k % 5).alias("pages_audited"),
        (F.col("s_acctbal") / 100).alias("seconds"),
        (k % 3 == 0).alias("degraded_mode"),
        (k % 101).alias("score"),
        F.when(k % 2 == 0, k % 50).alias("overall_score"),
        (k % 13).alias("total_issues"),
        F.when(k % 8 == 0, "partial").alias("enrichment_status"),
        F.when(k % 2 == 0, F.array(F.lit("dom"), F.lit("rules"))).alias("engines_used"),
        F.create_map(F.lit("runtime_passed"), k % 4 != 1).alias("quality_gates"),
        F.create_map(F.lit("page_hits"), k % 6).alias("cache_counters"),
        F.when(k % 10 == 0, "Audit timed out early").otherwise("done").alias("summary"),
        F.when(k % 5 == 0, "browser timeout").when(k % 5 == 1, "dns_error").alias("degraded_reason"),
        F.when(k % 5 == 2, "status code 429").alias("degradation_reason"),
    )
    rows = telemetry.audit_events(results, _signals(spark, sf_dir)).drop("timestamp", "overall_score_distribution")
    shown = F.transform("top_issue_types", lambda t: F.concat(t["issue_type"], F.lit(":"), t["count"]))
    return rows.withColumns(
        {
            "shown_score": F.col("score_distribution.overall_score"),
            "issue_count": F.col("score_distribution.issue_count"),
            "top_issue_types": F.when(F.size("top_issue_types") > 0, F.array_join(shown, ",")),
            "engines_used": F.array_join("engines_used", ","),
            "runtime_passed": F.element_at("quality_gates", "runtime_passed").cast("string"),
            "page_hits": F.element_at("cache_counters", "page_hits"),
        }
    ).drop("score_distribution", "quality_gates", "cache_counters")


# stop rules ---------------------------------------------------------------------

LOG = duck("crawl_log")
_GAIN = f"""WITH r AS (SELECT *, CASE WHEN fetch_status = 'success' AND row_number() OVER (PARTITION BY site, fetch_status = 'success', signal ORDER BY ord) = 1 THEN 1 ELSE 0 END AS new,
  sum((fetch_status = 'success')::INT) OVER (PARTITION BY site ORDER BY ord) AS seen FROM {LOG}),
w AS (SELECT site, seen, sum(new) OVER (PARTITION BY site ORDER BY ord ROWS 2 PRECEDING) AS recent, sum(new) OVER (PARTITION BY site ORDER BY ord) AS total FROM r WHERE fetch_status = 'success'),
g AS (SELECT r.site, ord, new, total, CASE WHEN r.seen >= 3 THEN recent / greatest(total, 1) END AS gain FROM r LEFT JOIN w ON w.site = r.site AND w.seen = r.seen)
SELECT site, ord::INT AS ord, new::INT AS new, total::BIGINT AS total, round(gain, 6) AS gain, (min(ord) FILTER (ord >= 4 AND gain < 0.05::DOUBLE) OVER (PARTITION BY site))::INT AS stop_ord FROM g"""


@query(_GAIN)
def info_gain_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stop_rules.info_gain(fixture(spark, sf_dir, "crawl_log"))


@query(f"""WITH r AS (SELECT *, sum((fetch_status = 'success')::INT) OVER (PARTITION BY site ORDER BY ord) AS island FROM {LOG})
SELECT site, ord::INT AS ord, (sum((fetch_status <> 'success')::INT) OVER (PARTITION BY site, island ORDER BY ord))::BIGINT AS run, (sum((fetch_status <> 'success')::INT) OVER (PARTITION BY site ORDER BY ord))::BIGINT AS failed,
  round((sum((fetch_status <> 'success')::INT) OVER (PARTITION BY site ORDER BY ord)) / ord, 6) AS failure_rate, round((sum(round(duration_s * 1000)::BIGINT) OVER (PARTITION BY site ORDER BY ord)) / ord / 1000.0::DOUBLE, 9) AS mean_duration FROM r""")
def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stop_rules.failure_runs(fixture(spark, sf_dir, "crawl_log"))


@query(f"""WITH RECURSIVE t AS (SELECT site, ord, (fetch_status <> 'success')::INT AS bad, duration_s FROM {LOG} WHERE ord <= 40),
f AS (SELECT DISTINCT site, 0::BIGINT AS n, 0::BIGINT AS bad, 0.0::DOUBLE AS time, 40::BIGINT AS budget, 0::BIGINT AS cuts FROM t
  UNION ALL SELECT site, n, bad, time, CASE WHEN cut THEN kept ELSE budget END, cuts + cut::INT FROM (
    SELECT *, n >= 3 AND (bad / n > 0.3::DOUBLE OR time / n > 4.0::DOUBLE) AND budget - n > 1 AND kept < budget AS cut FROM (
      SELECT f.site, f.n + 1 AS n, f.bad + t.bad AS bad, f.time + t.duration_s AS time, budget, cuts, f.n + 1 + greatest(1, round_even(greatest(0, budget - f.n - 1) * (1.0 - 0.4)::DOUBLE, 0))::BIGINT AS kept
      FROM f JOIN t ON t.site = f.site AND t.ord = f.n + 1 WHERE f.n < f.budget)))
SELECT site, n::INT AS pages, budget::INT AS effective_max_pages, cuts::INT AS reductions FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC) AS r FROM f) WHERE r = 1""")
def adaptive_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stop_rules.adaptive_budget(fixture(spark, sf_dir, "crawl_log"), 40)


@query(f"""SELECT site, pages_crawled, unique_signals, pages_failed, round(unique_signals / pages_crawled, 3) AS intelligence_score, round(pages_failed / pages_crawled, 3) AS failure_rate,
  CASE WHEN pages_failed / pages_crawled > 0.2 THEN {q.text(rules.ADVICE['failures'])} WHEN unique_signals / pages_crawled < 0.1 AND pages_crawled > 5 THEN {q.text(rules.ADVICE['low_gain'])} ELSE {q.text(rules.ADVICE['none'])} END AS advice
  FROM (SELECT site, count(*)::BIGINT AS pages_crawled, count(DISTINCT signal) FILTER (fetch_status = 'success')::BIGINT AS unique_signals, count(*) FILTER (fetch_status <> 'success')::BIGINT AS pages_failed FROM {LOG} GROUP BY site)""")
def crawl_reflection(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.col("fetch_status") == "success"
    crawls = fixture(spark, sf_dir, "crawl_log").groupBy("site").agg(
        F.count(F.lit(1)).alias("pages_crawled"), F.count_distinct(F.when(good, F.col("signal"))).alias("unique_signals"), F.count_if(~good).alias("pages_failed")
    )
    return stop_rules.reflection(crawls)


@query(f"SELECT site, count(*)::BIGINT AS pages, CASE WHEN site % 3 = 0 THEN 'aborted' WHEN site % 3 = 1 THEN 'partial' ELSE 'completed' END AS status FROM {LOG} GROUP BY site")
def crawl_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture(spark, sf_dir, "crawl_log").groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    stop = F.when(F.col("site") % 3 == 0, F.when(F.col("site") % 2 == 0, "failure_threshold").otherwise("global_timeout")).when(F.col("site") % 3 == 1, "low_information_gain")
    return rows.withColumn("status", failures.crawl_status(stop, F.col("site") % 3 == 1))


@query(f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'fast' WHEN 1 THEN 'deep' WHEN 2 THEN 'max' ELSE 'deep' END AS mode, CASE event_id % 4 WHEN 0 THEN 8 WHEN 2 THEN 20 ELSE 12 END AS low, CASE event_id % 4 WHEN 0 THEN 10 WHEN 2 THEN 40 ELSE 15 END AS high, least(15.0::DOUBLE, CASE WHEN event_id % 3 = 0 THEN 7.5::DOUBLE ELSE pow(2, event_id % 5 + 1) END) AS backoff, CASE WHEN event_id % 2 = 0 THEN 12 ELSE 10 END AS timeout FROM events")
def scan_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    raw = F.element_at(F.array(F.lit(" Light"), F.lit("standard"), F.lit("FULL"), F.lit("deep")), (i % 4 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", urls.scan_mode(raw).alias("mode"))
    retry = F.when(i % 3 == 0, "7.5").when(i % 3 == 1, "soon")
    return rows.select(
        "event_id",
        "mode",
        requests.timeout_bounds(F.col("mode"))["low"].alias("low"),
        requests.timeout_bounds(F.col("mode"))["high"].alias("high"),
        urls.backoff_seconds(i % 5, retry).alias("backoff"),
        requests.page_timeout(F.when(i % 2 == 0, "nav").otherwise("standard"), F.lit(12)).alias("timeout"),
    )
