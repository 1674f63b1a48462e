"""URL functions as Column builders; all stay inside whole-stage code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

#: Groups: scheme, authority, path, query, fragment.
RFC3986 = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def any_of(text: Column, tokens: list[str]) -> Column:
    """Whether the text holds any of the literal tokens."""
    return text.rlike("|".join(re.escape(t) for t in tokens))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, RFC3986, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, RFC3986, 2)


def path(url: Column) -> Column:
    """Path without the last segment's ;parameters."""
    return F.regexp_replace(F.regexp_extract(url, RFC3986, 3), ";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, RFC3986, 4)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, RFC3986, 5)


def _host_port(url: Column) -> Column:
    return F.regexp_replace(authority(url), "^.*@", "")


def host(url: Column) -> Column:
    """Lower-case host without brackets, user or port; empty if there is none."""
    hp = _host_port(url)
    return F.lower(F.when(hp.startswith("["), F.regexp_extract(hp, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(hp, "^([^:]*)", 1)))


def port(url: Column) -> Column:
    """Port number; null without one, or where the text behind the colon is no number."""
    return F.nullif(F.regexp_extract(_host_port(url), r":([0-9]{1,5})$", 1), F.lit("")).cast("int")


def _default_port(url: Column) -> Column:
    p, s = port(url), scheme(url)
    return p.isNull() | ((s == "http") & (p == 80)) | ((s == "https") & (p == 443))


def netloc(url: Column, brackets: bool = True) -> Column:
    """Host with a port other than the scheme's own."""
    h = host(url)
    if brackets:
        h = F.when(h.contains(":"), F.concat(F.lit("["), h, F.lit("]"))).otherwise(h)
    return F.when(host(url) == "", F.lower(authority(url))).when(_default_port(url), h).otherwise(
        F.concat(h, F.lit(":"), port(url).cast("string"))
    )


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(text: Column) -> Column:
    """Decoded (k, v) pairs of a query string, in order; blank values stay."""
    parts = F.filter(F.split(text, "&"), lambda p: p != "")
    cut = lambda p: F.locate("=", p)
    return F.transform(
        parts,
        lambda p: F.struct(
            _decoded(F.when(cut(p) > 0, F.substring(p, F.lit(1), cut(p) - 1)).otherwise(p)).alias("k"),
            _decoded(F.when(cut(p) > 0, F.substring(p, cut(p) + 1, F.length(p))).otherwise("")).alias("v"),
        ),
    )


def without_tracking(pairs: Column) -> Column:
    key = lambda p: F.lower(p["k"])
    return F.filter(pairs, lambda p: ~(key(p).startswith("utm_") | key(p).isin(rules.TRACKING_PARAMS)))


def query_string(pairs: Column) -> Column:
    """Encoded query of the pairs in sorted order."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def _assembled(url: Column, at: Column, to: Column, pairs: Column) -> Column:
    q = query_string(pairs)
    return F.concat(scheme(url), F.when(scheme(url) != "", ":").otherwise(""), F.lit("//"), at, to, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def normalize(url: Column) -> Column:
    """Canonical URL: no default port, fragment, parameters, trailing slash or tracking."""
    u = F.trim(url)
    p = path(u)
    p = F.when(p.isin("", "/"), "/").otherwise(F.rtrim(p, F.lit("/")))
    return _assembled(u, netloc(u), p, without_tracking(query_pairs(query(u))))


def dedup_key(url: Column) -> Column:
    """Key under which URLs are the same page; '' for one that cannot be fetched."""
    u = F.trim(F.coalesce(url, F.lit("")))
    p = path(u)
    stripped = F.rtrim(p, F.lit("/"))
    p = F.when(stripped == "", "/").otherwise(stripped)
    key = _assembled(u, netloc(u, brackets=False), p, query_pairs(query(u)))
    return F.when((scheme(u) == "") | (host(u) == ""), "").otherwise(key)


def segments(text: Column) -> Column:
    return F.filter(F.split(text, "/"), lambda s: s != "")


def depth(url: Column) -> Column:
    return F.size(segments(path(url)))


def has_binary_extension(url: Column) -> Column:
    return F.lower(path(url)).rlike("(?:" + "|".join(re.escape(e) for e in rules.BINARY_EXTENSIONS) + ")$")


def should_skip_href(href: Column) -> Column:
    raw = F.trim(F.coalesce(href, F.lit("")))
    starts = F.lower(raw).rlike("^(?:" + "|".join(re.escape(p) for p in rules.SKIP_HREF_PREFIXES) + ")")
    return (raw == "") | starts | any_of(F.lower(path(raw)), rules.SKIP_PATH_FRAGMENTS)


def priority_boost(url: Column) -> Column:
    return F.when(any_of(F.lower(path(url)), rules.PRIORITY_KEYWORDS), rules.PRIORITY_BOOST).otherwise(0.0)


def critical_type(url: Column) -> Column:
    """auth before form before product, else null."""
    p = F.lower(path(url))
    out = F.lit(None).cast("string")
    for name, tokens in reversed(rules.CRITICAL_TOKENS.items()):
        out = F.when(any_of(p, tokens), name).otherwise(out)
    return out


def is_homepage(url: Column) -> Column:
    return path(url).isin(rules.HOMEPAGES)


def is_paginated(url: Column) -> Column:
    return url.rlike(rules.PAGINATION)


def template_signal(url: Column) -> Column:
    """First two segments of the path, or the whole path if it has fewer."""
    p = path(url)
    s = segments(p)
    return F.when(F.size(s) >= 2, F.concat(F.lit("/"), F.array_join(F.slice(s, 1, 2), "/"))).when(p == "", "/").otherwise(p)


def is_disallowed(url: Column, prefixes: Column) -> Column:
    """Whether the path starts with any of an array of prefixes."""
    p = F.when(path(url) == "", "/").otherwise(path(url))
    return F.exists(prefixes, lambda x: F.startswith(p, x))


def _without_dots(parts: Column) -> Column:
    """Segments of an absolute path with . and .. resolved; parts begin with ''."""
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        F.slice(parts, F.lit(1), F.size(parts)),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def resolve(base: Column, href: Column) -> Column:
    """Absolute URL of a reference, by RFC 3986."""
    raw_path = lambda u: F.regexp_extract(u, RFC3986, 3)
    has_query = lambda u: u.rlike(r"^[^#]*\?")
    tail = F.concat(
        F.when(query(href) != "", F.concat(F.lit("?"), query(href))).otherwise(""),
        F.when(fragment(href) != "", F.concat(F.lit("#"), fragment(href))).otherwise(""),
    )
    front = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_extract(raw_path(base), "^(.*/)", 1)
    merged = F.when(raw_path(href).startswith("/"), raw_path(href)).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), raw_path(href)))
    base_query = F.when(query(base) != "", F.concat(F.lit("?"), query(base))).otherwise("")
    mark = F.when(fragment(href) != "", F.concat(F.lit("#"), fragment(href))).otherwise("")
    return (
        F.when(href == "", base)
        .when((scheme(href) != "") & (scheme(href) != scheme(base)), href)
        .when(authority(href) != "", F.concat(scheme(base), F.lit("://"), authority(href), raw_path(href), tail))
        .when(raw_path(href) == "", F.concat(front, raw_path(base), F.when(has_query(href), F.when(query(href) != "", F.concat(F.lit("?"), query(href))).otherwise("")).otherwise(base_query), mark))
        .otherwise(F.concat(front, _without_dots(F.split(merged, "/")), tail))
    )


def scan_mode(raw: Column) -> Column:
    """fast, deep or max; an error for anything else."""
    mode = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    out = F.raise_error(F.concat(F.lit("unknown scan mode: "), mode)).cast("string")
    for name, names in rules.MODE_ALIASES.items():
        out = F.when(mode.isin(names), name).otherwise(out)
    return out


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def safe_double(raw: Column, default: float) -> Column:
    """Number in a string, else the default."""
    return safe_double_or(raw, F.lit(float(default)))


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def backoff_seconds(attempt: Column, retry_after: Column) -> Column:
    """Wait before the next try: the server's wish or a power of two, 15 s at most."""
    return F.least(F.lit(15.0), safe_double_or(retry_after, F.pow(F.lit(2.0), attempt + 1)))


def safe_double_or(raw: Column, other: Column) -> Column:
    return F.coalesce(F.trim(raw).try_cast("double"), other)


def bench_page_type(url: Column) -> Column:
    """Coarse page kind used by the reports."""
    p = F.lower(path(url))
    return (
        F.when(p.isin("", "/", "/index.html"), "home")
        .when(p.contains("page-"), "pagination")
        .when(p.contains("category"), "category")
        .when(p.contains("catalogue/"), "product")
        .otherwise("other")
    )
