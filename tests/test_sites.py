"""Topology, discovery, sitemaps, crawl, store, reports, sources."""

import http.server
import random
import threading

import pytest
from pyspark.sql import functions as F

from siteweave.functions import rules
from siteweave.operators import crawl, discovery, report, scoring, sitemaps, stop_rules, store, topology
from siteweave.sources import web


def topo(spark, urls):
    df = spark.createDataFrame([("s", i, u) for i, u in enumerate(urls)], "site string, pos long, url string")
    return topology.detect_topology(df).first()


def test_topology_golden(spark):
    h = "https://h"
    r = topo(spark, [h + "/", *[f"{h}/page/{i}" for i in range(1, 20)], *[f"{h}/blog/post-{i}" for i in range(10)]])
    assert (r.topology, r.templates_found, r.total_discovered, r.skipped_urls) == ("paginated", 2, 30, 26)
    assert r.crawl_urls == [h + "/", *[f"{h}/blog/post-{i}" for i in range(3)]]
    r = topo(spark, [h + "/"])
    assert (r.topology, r.templates_found, r.crawl_urls) == ("single_page", 1, [h + "/"])
    r = topo(spark, [f"{h}/?page={i}" for i in range(3)])
    assert (r.topology, r.templates_found, r.crawl_urls) == ("paginated", 0, [h + "/?page=0"])
    r = topo(spark, [f"{h}/product/{i}" for i in range(30)] + [f"{h}/product/1"])
    assert (r.topology, r.templates_found, r.total_discovered, len(r.crawl_urls)) == ("deep_uniform", 1, 30, 3)


def test_topology_boundary_of_structural_segments(spark):
    urls = [f"https://h/{s}/x{i}" for i in range(6) for s in ("a", "b", "c", "d")]
    assert topo(spark, urls).topology == "deep_uniform"  # each section has a quarter of the paths
    assert topo(spark, [u for u in urls if "/d/" not in u]).topology == "multi_template"


def test_topology_caps_urls(spark):
    r = topo(spark, [f"https://h/item/{i}" for i in range(700)])
    assert r.total_discovered == 700 and r.skipped_urls == rules.TOPOLOGY_CAP - 3


def plain_coverage(items, cap):
    """The rule, step by step, on (score, depth, url, type)."""
    items = sorted(items, key=lambda r: (-r[0], r[1], r[2]))
    chosen = items[:cap]
    for kind in sorted({r[3] for r in items if r[3]} - {r[3] for r in chosen}):
        chosen.append(next(r for r in items if r[3] == kind))
        if len(chosen) > cap:
            for i in reversed(range(len(chosen))):
                if not chosen[i][3] or sum(r[3] == chosen[i][3] for r in chosen) > 1:
                    break
            else:
                i = len(chosen) - 1
            chosen.pop(i)
    return {r[2] for r in chosen}


def test_critical_coverage_like_the_stepwise_rule(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for cap in (1, 2, 3, 5, 8):
        for site in range(12):
            name = f"{cap}-{site}"
            items = [(rng.randrange(5) / 10, rng.randrange(3), f"u{i}", rng.choice([None, None, "auth", "form", "product"])) for i in range(rng.randrange(1, 10))]
            rows += [(cap, name, *i) for i in items]
            want[name] = plain_coverage(items, cap)
    df = spark.createDataFrame(rows, "cap int, site string, priority_score double, depth int, url string, page_type string")
    got = {}
    for cap in (1, 2, 3, 5, 8):
        for r in discovery.covered(df.where(F.col("cap") == cap).drop("cap"), cap).collect():
            got.setdefault(r.site, set()).add(r.url)
    assert got == want


def test_bfs_order_and_parents(spark):
    edges = spark.createDataFrame([("s", "a", "c"), ("s", "a", "b"), ("s", "b", "d"), ("s", "c", "d"), ("s", "d", "a")], "site string, src string, dst string")
    seeds = spark.createDataFrame([("s", "a")], "site string, url string")
    got = [tuple(r) for r in discovery.bfs(edges, seeds, 5).orderBy("place").select("url", "depth", "parent", "place").collect()]
    assert got == [("a", 0, None, 1), ("b", 1, "a", 2), ("c", 1, "a", 3), ("d", 2, "b", 4)]
    assert discovery.bfs(edges, seeds, 5, 2).count() == 2


def test_robots_and_sitemaps(spark):
    robots = spark.createDataFrame([("https://h", "User-agent: *\r\nDisallow: /x\n#Disallow: /no\nUser-agent: a\nDisallow: /y\nSitemap: /m.xml"), ("https://i", None)], "site string, text string")
    closed = sitemaps.disallowed_prefixes(robots)
    assert [tuple(r) for r in closed.collect()] == [("https://h", "/x")]
    places = sitemaps.sitemap_locations(robots.select("site", F.col("site").alias("origin")), robots)
    assert places.groupBy("site").count().orderBy("site").collect() == [("https://h", 1), ("https://i", 4)]
    docs = [
        ("https://h/m.xml", "<x:sitemapindex xmlns:x='u'><x:sitemap><x:loc>n.xml</x:loc></x:sitemap><x:sitemap><x:loc>m.xml</x:loc></x:sitemap><x:sitemap/></x:sitemapindex>"),
        ("https://h/n.xml", "<urlset><url><loc> /a?utm_x=1 </loc><priority>7</priority></url><url><loc>/x/1</loc></url><url><loc>/a</loc></url><url><loc>https://o/</loc></url><url><loc>/cart</loc><priority>bad</priority><lastmod>2024</lastmod></url></urlset>"),
        ("https://i/sitemap.xml", "<urlset><url>"),
    ]
    got = sitemaps.sitemap_urls(places, spark.createDataFrame(docs, "url string, xml string"), closed).orderBy("place").collect()
    assert [(r.url, r.priority, r.lastmod) for r in got] == [("https://h/a", 1.0, None), ("https://h/cart", 0.8, "2024")]


# crawl ----------------------------------------------------------------------------


def kind(text, nav):
    return ("interaction", 2, 0.9) if "cart" in text else ("nav", 3, 0.8) if nav else ("standard", 4, 0.7)


def plain_crawl(cfg, site, pages, links):
    """The crawl of one site, page by page."""
    import heapq

    cfg = cfg.normalized()
    seed = f"https://{site}/"
    heap, seen, count = [(1, 0, 0, seed, "homepage")], {seed}, 1
    n = failed = run = low = lost = dedup = deep = cuts = 0
    budget, width, time, stop, recent, signals, topology_at, order = cfg.max_pages, cfg.concurrency, 0.0, None, [], set(), None, []
    while heap and n < budget:
        if time >= cfg.global_timeout_s:
            stop = "global_timeout"
            break
        rate = failed / n if n else 0.0
        if n >= 2 and rate >= cfg.failure_rate_stop_threshold:
            stop = "failure_threshold"
            break
        if rate > cfg.failure_rate_reduce_threshold and width > 1:
            width -= 1
        if run >= 3:
            stop = "failure_threshold"
            break
        batch = []
        while heap and len(batch) < width and (not batch or n + len(batch) < budget):
            e = heapq.heappop(heap)
            if e[1] > cfg.max_depth:
                deep += 1
                continue
            batch.append(e)
        if not batch:
            break
        halt = False
        for _, depth, _, url, page_type in sorted(batch, key=lambda e: e[3]):
            status, reason, seconds, found = pages.get(url, ("success", None, 0.0, []))
            n, time = n + 1, time + seconds
            order.append(url)
            good = status == "success"
            if good:
                path = "/" + url.split("/", 3)[3]
                segs = [s for s in path.split("/") if s]
                new = {*found, "template:" + ("/" + "/".join(segs[:2]) if len(segs) >= 2 else path)} - signals
                signals |= new
                recent = [*recent, len(new)][-cfg.low_information_window :]
                run = 0
            else:
                failed += 1
                if reason == "bot_wall":
                    halt, stop = True, stop or "non_recoverable:bot_wall"
                elif reason == "render_timeout":
                    width = max(1, width // 2)
                else:
                    run += 1
            room = max(0, budget - n)
            best = {}
            for href, text, nav in links.get(url, []):
                t = kind(href, nav)
                if depth + 1 >= 2 and t[0] == "standard":
                    continue
                best[href] = min(best.get(href, (9,)), (t[1], href, t[0]))
            for tier, href, t in sorted(best.values()):
                if not good:
                    lost += 1
                elif t == "standard" and room <= 1:
                    low += 1
                elif href in seen:
                    dedup += 1
                else:
                    seen.add(href)
                    heapq.heappush(heap, (tier, depth + 1, count, href, t))
                    count += 1
            if n >= 3 and (failed / n > 0.30 or time / n > cfg.avg_page_time_reduce_threshold_s) and room > 1:
                limit = n + max(1, int(round(room * (1.0 - cfg.adaptive_budget_reduce_ratio))))
                if limit < budget:
                    budget, cuts = limit, cuts + 1
            if n >= 4 and len(recent) == 3 and sum(recent) / max(1, len(signals)) < 0.05:
                stop, halt = "low_information_gain", True
                break
            if n >= budget or halt:
                halt = True
                break
            if topology_at is None and n in rules.TOPOLOGY_MILESTONES and len(heap) >= 5:
                topology_at = n
            if time >= cfg.global_timeout_s:
                stop = "global_timeout"
                break
        if halt or stop:
            break
    return order, (n, failed, budget, cuts, low, lost, dedup, deep, stop, len(heap), len(signals), topology_at is not None)


def test_crawl_like_the_stepwise_rule(spark):
    rng = random.Random(5)
    cfg = crawl.CrawlConfig(max_pages=9, concurrency=3, global_timeout_s=25)
    pages, links, want = {}, {}, {}
    for s in range(14):
        site = f"s{s}.example"
        names = [f"https://{site}/"] + [f"https://{site}/{rng.choice(['a', 'b', 'cart', 'c/d'])}{i}" for i in range(rng.randrange(3, 16))]
        for u in names:
            bad = rng.random() < (0.1, 0.35)[s % 2]
            reason = rng.choice(["render_timeout", "engine_error", "extraction_failed", "bot_wall"]) if bad else None
            pages[u] = ("error" if bad else "success", reason, rng.randrange(8) / 2, rng.sample(["p", "q", "r"], rng.randrange(2)))
            links[u] = [(v, "", rng.random() < 0.5) for v in rng.choices(names, k=rng.randrange(8))]
        want[site] = plain_crawl(cfg, site, pages, links)
    seeds = spark.createDataFrame([(s, f"https://{s}/") for s in want], "site string, seed_url string")
    p = spark.createDataFrame([(u, *v) for u, v in pages.items()], "url string, fetch_status string, failure_reason string, duration_s double, signals array<string>")
    e = spark.createDataFrame([(u, h, t, n, False) for u, v in links.items() for h, t, n in v], "url string, href string, text string, in_nav boolean, in_header_footer boolean")
    sites, crawled = crawl.crawl(seeds, p, e, cfg)
    for r in sites.collect():
        n, failed, budget, cuts, low, lost, dedup, deep, stop, left, unique, labelled = want[r.site][1]
        got = (r.pages_crawled, r.pages_failed, r.effective_max_pages, r.budget_reductions, r.skipped_low_value, r.skipped_due_to_failure, r.skipped_dedup, r.skipped_depth, r.stop_reason, r.queue_remaining, r.unique_signals, r.topology != "UNKNOWN")
        assert got == (n, failed, budget, cuts, low, lost, dedup, deep, stop, left, unique, labelled), r.site
    order = {}
    for r in crawled.orderBy("site", "page_no").collect():
        order.setdefault(r.site, []).append(r.url)
    assert order == {s: o for s, (o, _) in want.items()}


def test_config_clamps():
    c = crawl.CrawlConfig(scan_mode="thorough", concurrency=9, timeout_per_page_s=0, max_pages=0, adaptive_budget_reduce_ratio=0.9).normalized()
    assert (c.scan_mode, c.concurrency, c.timeout_per_page_s, c.max_pages, c.adaptive_budget_reduce_ratio, c.global_timeout_s) == ("max", 2, 30, 1, 0.5, 30)
    assert crawl.CrawlConfig(concurrency=9).normalized().concurrency == 3
    with pytest.raises(ValueError):
        crawl.CrawlConfig(scan_mode="odd").normalized()


def test_info_gain_stops_after_four_repeats(spark):
    log = spark.createDataFrame([(1, i, "success", "t") for i in range(1, 7)] + [(2, i, "success", f"t{i}") for i in range(1, 7)], "site int, ord int, fetch_status string, signal string")
    got = {r.site: r.stop_ord for r in stop_rules.info_gain(log).select("site", "stop_ord").distinct().collect()}
    assert got == {1: 4, 2: None}


def test_scores_use_defaults_for_zero_weights(spark):
    pages = spark.createDataFrame([("s", "success", 80.0, 0.0), ("s", "success", 40.0, 0.7), ("s", "error", 0.0, 1.0), ("t", "error", 1.0, 1.0)], "site string, audit_status string, score double, page_weight double")
    issues = spark.createDataFrame([("s", "critical")] * 3, "site string, severity string")
    got = {r.site: r.score for r in scoring.weighted_score(pages, issues).collect()}
    assert got == {"s": 54.0, "t": None}


def test_session_store(spark, tmp_path):
    s = store.SessionStore(spark, f"file://{tmp_path}/session")
    s.initialize()
    s.initialize()
    row = [("https://h/a", "https://h/a", 0, "nav", 0.8), ("https://h/b", "", 1, "nav", 0.8)]
    q = spark.createDataFrame(row, store.QUEUE)
    s.enqueue(q)
    s.enqueue(q)
    assert s.pending().count() == 2
    s.mark(spark.createDataFrame([("https://h/a", "processing", 1), ("https://h/a", "completed", 2), ("https://h/b", "failed:engine_error", 1)], store.STATUS))
    assert s.pending().count() == 0 and [r[0] for r in s.seen().collect()] == ["https://h/a"]
    for i in (1, 2):
        s.save_results(spark.createDataFrame([("https://h/a", i, f"v{i}")], "url string, seq long, value string"))
    assert [tuple(r) for r in s.results().collect()] == [("https://h/a", '{"value":"v2"}')]
    s.clear()
    assert s.pending().count() == 0 and spark.read.parquet(f"{tmp_path}/session/meta").count() == 1


def test_reports(spark, tmp_path):
    pages = spark.createDataFrame([("https://h/", "homepage", None, False), ("https://h/" + "x" * 40, "nav", "https://h/", True), ("https://h/z", "nav", "https://gone/", False)], "url string, page_type string, parent_url string, js_required boolean")
    text = report.mermaid(pages, str(tmp_path / "g.mmd"))
    assert text.startswith("graph TD") and text.count("-->") == 1 and "..." + "x" * 27 in text
    assert "mermaid" in open(report.html_report(pages, str(tmp_path / "r.html"))).read()
    jobs = report.jobs(pages.withColumn("topology", F.lit("thin")))
    assert sorted(r.engine for r in jobs.collect()) == ["fetch", "fetch", "playwright"]
    assert "JOBS" in open(report.job_script(jobs, str(tmp_path / "j.py"))).read()


def test_interaction_candidates(spark):
    rows = [
        (1, 1, "button", None, "Open Menu", None, False, False, None, None, None), (1, 2, "div", "button", "", None, False, False, "Main nav", None, None),
        (1, 3, "a", None, "Show more", "/m", True, False, None, "dialog", None), (1, 4, "div", None, "x", None, False, False, None, None, "pane"),
    ]
    df = spark.createDataFrame(rows, "page int, seq int, tag string, role string, text string, href string, in_nav boolean, in_header boolean, aria_label string, aria_haspopup string, aria_controls string")
    got = sorted((r.kind, r.seq) for r in discovery.candidates(df).collect())
    assert got == [("load_more", 3), ("menu", 1), ("menu", 2), ("modal", 3), ("modal", 4), ("nav_hover", 3), ("route_change", 3)]


def test_http_pages(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/ok" else 404)
            self.end_headers()
            self.wfile.write(b"<a href='/x'>x</a>")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        web.register(spark)
        got = {r.url: (r.status, r.html) for r in spark.read.format("http_pages").option("urls", f"{base}/ok {base}/no http://127.0.0.1:1/").load().collect()}
    finally:
        server.shutdown()
    assert got == {f"{base}/ok": (200, "<a href='/x'>x</a>"), f"{base}/no": (404, ""), "http://127.0.0.1:1/": (None, "")}


def test_backoff_waits_as_asked():
    waits = []

    class Handler(http.server.BaseHTTPRequestHandler):
        asked = iter(["3", "soon", ""])

        def do_GET(self):
            self.send_response(429)
            self.send_header("Retry-After", next(self.asked))
            self.end_headers()

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        assert web.get_with_backoff(f"http://127.0.0.1:{server.server_port}/", wait=waits.append) == (429, "")
    finally:
        server.shutdown()
    assert waits == [3.0, 4.0]
