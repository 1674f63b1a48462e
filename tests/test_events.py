"""Events, metrics text, recorded sources, rolling windows."""

import datetime as dt

from pyspark.sql import functions as F

from siteweave.operators import crawl, events, links, scoring, telemetry
from siteweave.sources import scratch, web
from siteweave.streaming import jobs


def audit_rows(spark, ids):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(i, t + dt.timedelta(seconds=i), ["fast", "deep", "odd"][i % 3], float(i), 2.0, i % 4 == 0, i % 5 == 0, "complete", 0.5) for i in ids],
        "event_id long, ts timestamp_ntz, scan_mode string, duration_ms double, pages_audited double, timeout boolean, degraded_mode boolean, enrichment_status string, fallback_rate double",
    )


def test_rolling_alerts_over_batches(spark):
    alerts = jobs.RollingAlerts(spark, 20)
    for n, ids in enumerate([range(0, 15), range(10, 30), range(30, 40)]):
        alerts.write(audit_rows(spark, ids), n)
        alerts.write(audit_rows(spark, ids), n)  # a batch that runs again changes nothing
    assert alerts.snapshot().collect() == telemetry.alert_snapshot(audit_rows(spark, range(20, 40)), 20).collect()


def test_metrics_have_a_row_for_every_mode_and_text(spark):
    rows = {(r.metric, r.label): r.value for r in telemetry.metrics(audit_rows(spark, range(6))).collect()}
    assert rows["audit_duration_p50_ms", "fast"] == 1.5 and rows["audit_duration_p50_ms", "max"] == 0.0
    lines = {r.line for r in telemetry.exposition(telemetry.metrics(audit_rows(spark, range(6)))).collect()}
    assert 'siteweave_audit_duration_p50_ms{mode="deep"} 2.50' in lines and "siteweave_enrichment_fallback_rate 0.500000" in lines
    empty = telemetry.alert_snapshot(audit_rows(spark, range(1)).limit(0)).first()
    assert tuple(empty) == (0.0, 0.0, 0.0)
    rate = spark.range(1).select(telemetry.hit_rate(F.create_map(F.lit("dom_hits"), F.lit(3), F.lit("dom_misses"), F.lit(1)), "dom")).first()[0]
    assert rate == 0.75


def test_bursts_count_both_ends(spark):
    t = dt.datetime(2024, 1, 1, 0, 59, 50)
    rows = [(i, t + dt.timedelta(seconds=s), True) for i, s in enumerate([0, 10, 20, 21])]
    got = {r.event_id: r.failures for r in telemetry.bursts(spark.createDataFrame(rows, "event_id long, ts timestamp, timeout boolean"), 10).collect()}
    assert got == {0: 1, 1: 2, 2: 2, 3: 2}


def test_crawl_events_and_json_lines(spark, tmp_path):
    seeds = spark.createDataFrame([("h", "https://h/")], "site string, seed_url string")
    pages = web.recorded(spark.createDataFrame([("https://h/",), ("https://h/cart",)], "url string"))
    out = spark.createDataFrame([("https://h/", "/cart", "cart", False, False)], "url string, href string, text string, in_nav boolean, in_header_footer boolean")
    sites, crawled = crawl.crawl(seeds, pages, out, crawl.CrawlConfig(max_pages=3))
    log = events.crawl_events(sites, crawled)
    assert [r.event_type for r in log.orderBy("seq").collect()] == ["crawl_started", "page_crawled", "page_crawled", "crawl_completed"]
    events.append_json_lines(events.operational("crawl", log.select("site", "payload")), f"{tmp_path}/log")
    events.append_json_lines(events.operational("", log.select("site")), f"{tmp_path}/log")
    kept = spark.read.json(f"{tmp_path}/log")
    assert kept.count() == 8 and {r.event_type for r in kept.collect()} == {"crawl", "operational"}
    assert crawl.page_summaries(crawled, sites).first().page_summaries[1].url == "https://h/cart"


def test_sources(spark):
    pages = spark.createDataFrame([(1, "https://h/", "<a href='/x'>x</a>"), (2, "https://i/", "<div id=root></div>")], "page_id long, url string, html string")
    static = links.html.exact_anchors(pages)
    rendered = links.html.exact_anchors(pages.withColumn("html", F.lit("<a href='/r'>r</a>")))
    got = {r.page_id: [a.href for a in r.anchors] for r in web.static_or_rendered(static, rendered).collect()}
    assert got == {1: ["/x"], 2: ["/r"]}
    fetched = spark.createDataFrame([("", "<p>c</p>", 200), ("<p>h</p>", "c", 404)], "html string, cleaned_html string, status int")
    assert [r.text for r in web.html_of(fetched).collect()] == ["<p>c</p>", None]
    status = spark.createDataFrame([("https://i/", "error", "dns", 1.5)], "url string, fetch_status string, failure_reason string, duration_s double")
    assert {r.url: r.fetch_status for r in web.recorded(pages, status).collect()} == {"https://h/": "success", "https://i/": "error"}
    hrefs = spark.range(1).select(events.merged_hrefs(F.array(F.lit("/a"), F.lit(" ")), F.array(F.lit("/b"), F.lit("/a")))).first()[0]
    assert hrefs == ["/a", "/b"]


def test_rendered_mode_counts_roles(spark):
    page = '<div role="banner"><a href="/x">x</a></div>'
    df = spark.createDataFrame([(page,)], "html string")
    get = lambda rendered: df.select(links.html.anchors(F.col("html"), rendered)).first()[0][0].in_header_footer
    assert (get(False), get(True)) == (False, True)


def test_reduction_report(spark):
    rows = [("a", 10, 4, 10.0, 5.0, 2, 2), ("b", 10, 8, 1.0, 1.0, 1, 2), ("c", 10, 7, 1.0, 1.0, 3, 2), ("d", 10, 12, 1.0, 2.0, 1, 2), ("e", 0, 0, 0.0, 0.0, 0, 0)]
    df = spark.createDataFrame(rows, "site string, base_pages int, pages int, base_s double, s double, templates int, base_templates int")
    got = {r.site: (r.page_reduction, r.outcome) for r in scoring.reduction_report(df).collect()}
    assert got == {"a": (60.0, "ELITE"), "b": (20.0, "STABLE"), "c": (30.0, "PASS"), "d": (-20.0, "REGRESSED"), "e": (0.0, "STABLE")}


def test_scratch_tables_can_be_cleared(spark):
    kept = scratch.written(spark.range(3))
    assert kept.count() == 3
    place = scratch.own_dir(spark)
    fs = spark._jvm.org.apache.hadoop.fs.Path(place)
    assert fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
    scratch.clear(spark)
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)


def test_baseline_counts_every_request(spark):
    rows = [("h", "https://h/a", 200, "xx"), ("h", "https://h/a", 503, "xxx"), ("h", "https://h/a", None, None), ("h", None, 404, "x"), ("h", "https://h/b", 200, None), (None, None, 200, "é")]
    got = events.bfs_baseline(spark.createDataFrame(rows, "site string, url string, status int, html string"))
    assert {tuple(r) for r in got.collect()} == {("h", 5, 3, 1, 2, 3), (None, 1, 0, 0, 2, 1)}


def test_fallback_of_every_scan(spark):
    """A seed that is scanned twice has two results; without an id its tries are one scan."""
    seeds = spark.createDataFrame([(1, "https://h/a"), (2, "https://h/a")], "id long, url string")
    page = F.when(F.col("id") == 1, F.lit("<main>" + "x" * 41 + "</main>")).when(F.col("pos") == 1, F.lit("<input type=password>" + "x" * 41))
    tries = events.fallback_candidates(seeds).withColumn("html", page)
    got = {tuple(r) for r in events.public_fallback(tries, ("id", "seed")).collect()}
    assert got == {(1, "https://h/a", "https://h/about", "public"), (2, "https://h/a", "https://h/explore", "partial")}
    assert [tuple(r) for r in events.public_fallback(tries).collect()] == [("https://h/a", "https://h/about", "public")]
