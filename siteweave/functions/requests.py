"""Request policy: complexity, timeouts, user agents, blocking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules, urls


def page_complexity(url: Column) -> Column:
    """simple, moderate or heavy, by an additive score."""
    p, q, h = F.lower(urls.path(url)), F.lower(urls.query(url)), urls.host(url)
    one = lambda c, n=1: F.when(c, n).otherwise(0)
    score = (
        one(urls.any_of(h, rules.HEAVY_HOSTS), 2)
        + F.when(urls.any_of(p, rules.HEAVY_PATHS), 2).when(urls.any_of(p, rules.MODERATE_PATHS), 1).otherwise(0)
        + one(q != "")
        + one(F.length(q) > 64)
        + one(F.size(urls.segments(p)) >= 4)
        + one(F.lower(url).contains("?") & F.lower(url).contains("utm_"))
    )
    return F.when(score >= 4, "heavy").when(score >= 2, "moderate").otherwise("simple")


def _by(key: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def adaptive_timeouts(url: Column, mode: Column, page_s: Column, network_ms: Column, ready_ms: Column) -> Column:
    """Complexity-aware timeouts, rounded half to even and clamped."""
    m = F.when(F.lower(mode).isin(list(rules.PAGE_MULTIPLIERS)), F.lower(mode)).otherwise("fast")
    c = page_complexity(url)
    page = F.lit(None).cast("double")
    for name, table in rules.PAGE_MULTIPLIERS.items():
        page = F.when(m == name, _by(c, table)).otherwise(page)
    io = _by(c, rules.IO_MULTIPLIERS)
    rounded = lambda x: F.bround(x, 0).cast("int")
    low = _by(m, {k: v[0] for k, v in rules.PAGE_TIMEOUTS.items()})
    high = _by(m, {k: v[1] for k, v in rules.PAGE_TIMEOUTS.items()})
    return F.struct(
        c.alias("complexity"),
        F.greatest(low, F.least(high, rounded(page_s * page))).alias("page_timeout_seconds"),
        urls.clamp(rounded(network_ms * io), *rules.NETWORK_TIMEOUT_MS).alias("network_idle_timeout_ms"),
        urls.clamp(rounded(ready_ms * io), *rules.READY_TIMEOUT_MS).alias("ready_state_timeout_ms"),
    )


def timeout_bounds(mode: Column) -> Column:
    return F.struct(
        _by(mode, {k: v[0] for k, v in rules.TIMEOUT_BOUNDS.items()}).alias("low"),
        _by(mode, {k: v[1] for k, v in rules.TIMEOUT_BOUNDS.items()}).alias("high"),
    )


def page_timeout(page_type: Column, fallback_s: Column) -> Column:
    """Seconds a page may take: the fallback, within 15 for pages that lead on, else 10."""
    leads = F.lower(F.trim(F.coalesce(page_type, F.lit("")))).isin("homepage", "interaction", "nav")
    return F.greatest(F.lit(1), F.least(fallback_s, F.when(leads, 15).otherwise(10)))


def _digest(url: Column) -> Column:
    key = F.coalesce(F.nullif(urls.host(url), F.lit("")), url)
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")


def user_agent_index(url: Column, attempt: Column) -> Column:
    n = len(rules.USER_AGENTS)
    return ((_digest(url) % n + F.greatest(F.lit(0), F.coalesce(attempt, F.lit(0)))) % n).cast("int")


def user_agent(url: Column, attempt: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, rules.USER_AGENTS)), user_agent_index(url, attempt) + 1)


def request_headers(url: Column, attempt: Column) -> Column:
    fixed = [F.lit(x) for pair in rules.REQUEST_HEADERS.items() for x in pair]
    return F.create_map(F.lit("User-Agent"), user_agent(url, attempt), *fixed)


def delay_ms(url: Column) -> Column:
    return F.when(F.coalesce(url, F.lit("")) == "", 400).otherwise(400 + _digest(url) % 801).cast("int")


def fallback_urls(seed: Column) -> Column:
    """Public pages to try when the seed needs a login."""
    base = F.when(
        (urls.scheme(seed) != "") & (urls.authority(seed) != ""), F.concat(urls.scheme(seed), F.lit("://"), urls.authority(seed))
    ).otherwise(F.rtrim(seed, F.lit("/")))
    return F.array(*[F.concat(base, F.lit("/" + p)) for p in rules.FALLBACK_PATHS])


def _third_party(request: Column, seed: Column) -> Column:
    r, s = urls.host(request), urls.host(seed)
    return (r != "") & (s != "") & (r != s) & ~F.endswith(r, F.concat(F.lit("."), s))


def blocks_third_party(request: Column, seed: Column, kind: Column, allow_intercom: bool = False) -> Column:
    """Whether a script of a known tracker is blocked."""
    r, u = urls.host(request), F.lower(request)
    listed = r.isin(rules.WHITELIST_HOSTS) | r.endswith(".cloudfront.net")
    # facebook.com is a tracker only for its pixel; a listed intercom host wins or loses by where it stands in the list
    out = F.lit(False)
    for pattern in reversed(rules.TRACKER_HOSTS):
        verdict = F.lit(not (allow_intercom and "intercom" in pattern))
        passed = r.contains("facebook.com") & ~u.contains("/tr") if not (allow_intercom and "intercom" in pattern) else F.lit(False)
        out = F.when(r.contains(pattern) & ~passed, verdict).otherwise(out)
    return (F.lower(kind) == "script") & _third_party(request, seed) & ~listed & out


def blocks_for_performance(request: Column, seed: Column, kind: Column, allow_intercom: bool = False) -> Column:
    """Whether a request is blocked to make a scan lighter."""
    k, r, u = F.lower(F.coalesce(kind, F.lit(""))), urls.host(request), F.lower(request)
    third = _third_party(request, seed)
    tracker = urls.any_of(r, rules.TRACKER_HOSTS)
    spared = r.contains("intercom") if allow_intercom else F.lit(False)
    script = blocks_third_party(request, seed, k, allow_intercom) | (third & ~spared & (tracker | urls.any_of(u, rules.BLOCKED_URL_TOKENS)))
    return F.when(k.isin("image", "font", "media"), True).when(k == "script", script).when(k.isin("xhr", "fetch"), third & tracker).otherwise(False)


def request_bucket(kind: Column) -> Column:
    k = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(k.isin("image", "font", "media", "script", "xhr", "fetch"), k).otherwise("other")


def hydration(framework: Column, network_ready: Column, document_ready: Column) -> Column:
    return F.when(framework.isNotNull() & (framework != "") & (network_ready | document_ready), "hydrated").otherwise("uncertain")
