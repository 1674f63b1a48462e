"""Failures, requests, links, html markers."""

from pyspark.sql import functions as F

from siteweave.functions import failures, html, requests
from siteweave.operators import links


def test_failure_precedence(spark):
    rows = [
        ("bot_wall", None, "bot_wall"), ("blocked", None, "bot_wall"), (None, 429, "rate_limited"), (None, 403, "bot_wall"), (None, 500, "connectivity_blocked"),
        (None, 404, "bot_wall"), ("403", None, "engine_error"), (None, None, "engine_error"), ("timeout_exceeded", None, "render_timeout"),
        ("navigation timeout", None, "browser_navigation_failed"), ("HTTP status 429", None, "rate_limited"), ("dns lookup", 404, "connectivity_blocked"),
        ("CSP refused", None, "csp_injection_blocked"), ("html broke", None, "extraction_failed"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, raw string, status int, want string")
    got = df.orderBy("i").select(failures.normalize_failure(F.col("raw"), F.col("status"))).collect()
    assert [r[0] for r in got] == [r[2] for r in rows]


def test_failure_helpers(spark):
    df = spark.createDataFrame([("render_timeout", "x"), ("engine_error", None)], "r string, d string")
    got = df.select(failures.adaptive_action(F.col("r")), failures.reason_message(F.col("r"), F.col("d")), failures.exception_status(F.col("r"))).collect()
    assert tuple(got[0]) == ("slow_down", "Rendering exceeded timeout budget and partial data was used. (x)", "timeout")
    assert tuple(got[1]) == ("continue", "An internal scan engine error occurred.", "error")
    one = spark.range(1).select(
        failures.normalize_reason(F.lit(" ")).alias("a"),
        failures.fetch_status(F.lit(""), F.lit("error")).alias("b"),
        failures.crawl_status(F.lit("failure_threshold"), F.lit(False)).alias("c"),
        failures.is_captcha(F.lit(""), F.create_map(F.lit("Server"), F.lit("CloudFlare"))).alias("d"),
    ).first()
    assert tuple(one) == ("", "error", "aborted", True)


def test_csp_last_directive_counts(spark):
    values = ["script-src 'unsafe-inline'; script-src 'self'", "default-src *; script-src 'nonce-1'", "", None, "img-src *", "default-src 'self'"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, csp string")
    assert [r[0] for r in df.orderBy("i").select(failures.csp_blocks_inline(F.col("csp"))).collect()] == [True, False, False, False, False, True]


def test_requests(spark):
    seed = "https://shop.example.com/"
    rows = [
        ("https://www.facebook.com/tr?id", "script", True), ("https://www.facebook.com/sdk.js", "script", True), ("https://widget.intercom.io/x.js", "script", True),
        ("https://shop.example.com/a.js", "script", False), ("https://cdn.shop.example.com/a.js", "script", False), ("https://x/y.png", "image", True),
        ("https://api.mixpanel.com/t", "xhr", True), ("https://other/app.js", "script", False), ("https://other/pixel.js", "script", True),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, u string, k string, want boolean")
    got = df.orderBy("i").select(requests.blocks_for_performance(F.col("u"), F.lit(seed), F.col("k"))).collect()
    assert [r[0] for r in got] == [r[2] for r in rows]
    spared = df.where("i = 2").select(requests.blocks_for_performance(F.col("u"), F.lit(seed), F.col("k"), True)).first()[0]
    assert spared is False
    one = spark.range(1).select(
        requests.page_complexity(F.lit("https://www.amazon.com/checkout/a/b/c?utm_source=x")).alias("a"),
        requests.delay_ms(F.lit("")).alias("b"),
        F.array_join(requests.fallback_urls(F.lit("https://h/x")), " ").alias("c"),
        requests.hydration(F.lit("react"), F.lit(False), F.lit(True)).alias("d"),
        requests.request_headers(F.lit("https://h/"), F.lit(0))["Pragma"].alias("e"),
    ).first()
    assert tuple(one) == ("heavy", 400, "https://h/about https://h/explore https://h/features https://h/pricing", "hydrated", "no-cache")


PAGES = [
    '<nav><a href="/a">A &amp; <b>B</b></a></nav><header><a class=x href=\'/b\'> two\n words </a></header><p><a name="n">no</a><a href=/c>c</a>',
    '<!-- <a href="/no">x</a> --><script>var s = "<a href=\'/no\'>";</script><footer><nav><a href="/d"></a></nav></footer><a href="/e">open',
    "",
    None,
    '<a href="/f">one<a href="/g">two</a>',
]


def test_anchor_fold_agrees_with_a_parser(spark):
    df = spark.createDataFrame([(i, "https://h/", p) for i, p in enumerate(PAGES)], "page_id long, url string, html string")
    fold = links.page_links(df).orderBy("page_id", "pos").collect()
    exact = links.page_links(df, exact=True).orderBy("page_id", "pos").collect()
    assert fold == exact and len(fold) == 7
    assert [r.text for r in fold if r.href == "/a"] == ["A & B"]
    assert [(r.in_nav, r.in_header_footer) for r in fold if r.href in ("/a", "/b", "/d", "/e")] == [(True, False), (False, True), (True, True), (False, False)]


def test_markers_and_content(spark):
    pages = [
        ('<div id="__next"></div><div data-reactroot></div>', "https://h/", "hybrid", "none"), ("<app-root></app-root>", "https://h/sso", "angular", "url_login_redirect"),
        ('<form action="/signin"></form>', "https://h/", None, "login_form_present"), ("<p>Please log in</p>", "https://h/", None, "auth_prompt_without_main"),
        ("<main>log in</main>", "https://h/", None, "none"), ('<input type="password">', "https://h/", None, "password_field_present"),
        ('<meta name="robots" content="noindex">', "https://h/", None, "robots_noindex_without_main"),
    ]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "i int, html string, url string, f string, l string")
    for r in df.select("f", "l", html.spa_framework(F.col("html")).alias("gf"), html.login_wall(F.col("html"), F.col("url")).alias("gl")).collect():
        assert (r.gf, r.gl) == (r.f, r.l)
    text = spark.range(1).select(html.content(F.lit("<head><title>t</title></head><nav>n</nav><h1>A</h1><p>b &lt; <i>c</i></p>"))).first()[0]
    assert text == "A\nb < c"


def test_link_rules(spark):
    rows = [
        ("/cart", "", False, 1, None, "interaction"), ("/x", "Sign  In", False, 1, None, "interaction"), ("/page-x", "", False, 1, None, "nav"), ("/x", "", True, 1, None, "nav"),
        ("/x", "", False, 1, None, "standard"), ("/x", "", False, 2, "low_value_depth", "standard"), ("https://o/x", "", True, 1, "external", None),
        ("/a.pdf", "", True, 1, "exclusion_rule", None), ("/tag/x", "", True, 1, "low_value_pattern", None), ("/x?Sort=1", "", True, 1, "low_value_pattern", None),
        ("/page/2", "", True, 2, "exclusion_rule", None), ("/x?offset=1", "", True, 2, "exclusion_rule", None), ("/category/x", "", True, 3, "exclusion_rule", None),
        ("mailto:x", "", True, 1, "exclusion_rule", None),
    ]
    df = spark.createDataFrame([(i, "https://h/", r[0], r[1], r[2], False, r[3]) for i, r in enumerate(rows)], "page_id int, url string, href string, text string, in_nav boolean, in_header_footer boolean, d int")
    got = links.judged_links(df, F.lit("h"), F.col("d")).orderBy("page_id").collect()
    for r, want in zip(got, rows, strict=True):
        assert r.reason == want[4], want
        if want[5]:
            assert r["class"].page_type == want[5]
