from urllib.parse import parse_qsl, urlencode, urljoin, urlparse, urlunparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siteweave.functions import rules, urls


def run(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, url string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("url"))).collect()]


def plain_normalize(url):
    p = urlparse(url.strip())
    host = (p.hostname or "").lower()
    shown = f"[{host}]" if ":" in host else host
    if p.port and (p.scheme.lower(), p.port) not in (("http", 80), ("https", 443)):
        shown += f":{p.port}"
    path = p.path or "/"
    path = path if path == "/" else path.rstrip("/")
    pairs = [(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in rules.TRACKING_PARAMS]
    return urlunparse((p.scheme.lower(), shown, path if path != "" else "", "", urlencode(sorted(pairs)), ""))


GOLDEN = [
    ("https://Example.COM/path/?utm_source=google&q=test", "https://example.com/path?q=test"),
    ("http://h:80/a//", "http://h/a"),
    ("https://user@h:8443/x;p=1?b=2&a=#f", "https://h:8443/x?a=&b=2"),
    ("https://h/a?q=a%20b+c&q=*~", "https://h/a?q=%2A~&q=a+b+c"),
    ("http://[::1]:80/", "http://[::1]/"),
    ("https://h?a=%C3%A9", "https://h/?a=%C3%A9"),
]


def test_normalize_golden(spark):
    got = run(spark, [a for a, _ in GOLDEN], urls.normalize)
    assert got == [b for _, b in GOLDEN]
    assert [plain_normalize(a) for a, _ in GOLDEN] == [b for _, b in GOLDEN]


def test_normalize_is_idempotent(spark):
    once = run(spark, [a for a, _ in GOLDEN], urls.normalize)
    assert run(spark, once, urls.normalize) == once


def test_dedup_key(spark):
    got = run(spark, ["https://h:443/a/?b=2&a=&ref=x#f", "http://h//", "", None, "/a", "mailto:x", "http://[::1]:8080/a"], urls.dedup_key)
    assert got == ["https://h/a?a=&b=2&ref=x", "http://h/", "", "", "", "", "http://::1:8080/a"]


part = st.text("abz019.-_~", min_size=1, max_size=5)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(part, st.lists(part, max_size=3), st.lists(st.tuples(part, st.text("a +&=é*~", max_size=3)), max_size=3)), min_size=20, max_size=40))
def test_normalize_like_the_standard_library(spark, rows):
    made = []
    for host, path, query in rows:
        host = host.strip(".-_~") or "h"
        made.append(f"https://{host}/{'/'.join(path)}" + (f"?{urlencode(query)}" if query else ""))
    assert run(spark, made, urls.normalize) == [plain_normalize(u) for u in made]


@pytest.mark.parametrize("base", ["https://h/a/b?q=1#f", "https://h", "http://h/d/"])
def test_resolve_like_the_standard_library(spark, base):
    hrefs = ["", "#x", "?page=3", "../a", "../../../z", "./c/../d/.", "/r/./s", "//e.example/x?y#z", "http://o/p", "mailto:a@b", "sub/", "..", ".", "x?y=/../z"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hrefs)], "i int, href string")
    got = [r[0] for r in df.orderBy("i").select(urls.resolve(F.lit(base), F.col("href"))).collect()]
    expected = [urljoin(base, h) for h in hrefs]
    # an empty fragment or query is dropped by the library too, and an empty base path keeps its slash
    assert got == expected


def test_flags(spark):
    values = ["https://h/A.PDF", "https://h/page/2", "https://h/?p=3", "https://h/index.html", "https://h/a/b/c", "https://h/contact/login", "https://h/x?page=1"]
    assert run(spark, values, urls.has_binary_extension) == [True] + [False] * 6
    assert run(spark, values, urls.is_paginated) == [False, True, True, False, False, False, True]
    assert run(spark, values, urls.is_homepage) == [False, False, True, True, False, False, False]
    assert run(spark, values, urls.template_signal) == ["/A.PDF", "/page/2", "/", "/index.html", "/a/b", "/contact/login", "/x"]
    assert run(spark, values, urls.critical_type)[5] == "auth"
    assert run(spark, values, urls.depth) == [1, 2, 0, 1, 3, 2, 1]


def test_skip_href(spark):
    values = ["", None, "mailto:a", "#x", "JavaScript:1", "/cdn-cgi/l", "/ok", "https://h/.well-known/x"]
    assert run(spark, values, urls.should_skip_href) == [True, True, True, True, True, True, False, True]


def test_scan_mode_and_numbers(spark):
    assert run(spark, ["Light", " standard ", "FULL"], urls.scan_mode) == ["fast", "deep", "max"]
    with pytest.raises(Exception, match="unknown scan mode"):
        run(spark, ["odd"], urls.scan_mode)
    assert run(spark, [" 0.7 ", "x", None], lambda c: urls.safe_double(c, 0.5)) == [0.7, 0.5, 0.5]
    assert run(spark, ["3", "soon", "99"], lambda c: urls.backoff_seconds(F.lit(1), c)) == [3.0, 4.0, 15.0]
