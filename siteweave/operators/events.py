"""Crawl events, JSON-line sinks, page hooks and browser-side choices as table operators."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html, requests, rules, urls


def now_iso() -> Column:
    """Current UTC time in ISO form with a Z."""
    return F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def crawl_events(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """(site, seq, event_type, payload) of crawls: started, each page, completed; payload is JSON."""
    start = sites.select("site", F.lit(0).alias("seq"), F.lit("crawl_started").alias("event_type"), F.to_json(F.struct(F.col("seed_url").alias("site_url"))).alias("payload"))
    each = pages.select(
        "site",
        F.col("page_no").cast("int").alias("seq"),
        F.lit("page_crawled").alias("event_type"),
        F.to_json(F.struct("url", "fetch_status", F.col("duration_s"))).alias("payload"),
    )
    end = sites.select(
        "site",
        (F.col("pages_crawled") + 1).cast("int").alias("seq"),
        F.lit("crawl_completed").alias("event_type"),
        F.to_json(F.struct(F.col("seed_url").alias("site_url"), F.col("crawl_status").alias("status"))).alias("payload"),
    )
    return start.unionByName(each).unionByName(end)


def append_json_lines(events: DataFrame, path: str) -> None:
    """Append events to a folder of JSON lines, with the time they were recorded."""
    events.withColumn("timestamp", now_iso()).write.mode("append").json(path)


def operational(event_type: str, payload: DataFrame) -> DataFrame:
    """Rows of ``payload`` as operational events."""
    return payload.select(F.lit(event_type or "operational").alias("event_type"), *payload.columns)


def with_post_process(pages: DataFrame, hook: Callable[[str], str | None], column: str = "result") -> DataFrame:
    """Adds what a caller's function makes of each page; null where it fails or there is no page."""

    def safe(text: str | None) -> str | None:
        if not text:
            return None
        try:
            made = hook(text)
        except Exception:  # noqa: BLE001 - a hook's failure is a null, by contract
            return None
        return None if made is None else str(made)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(safe)

    return pages.withColumn(column, run(F.col("html")))


def merged_hrefs(dom: Column, mutations: Column) -> Column:
    """Links of a state: those in the document, then those that appeared later, each once."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(F.coalesce(dom, none), F.coalesce(mutations, none)), lambda h: F.trim(h) != ""))


def cookie_choice(handles: DataFrame, looked_at: int = 20) -> DataFrame:
    """(page, tier, seq) of the element that dismisses a cookie banner, one for each page that has one.

    ``handles`` has page, tier (0 by id or class, 1 by text, 2 by label), seq,
    text, aria_label and clickable.  Of each tier the first ``looked_at`` are
    looked at; a text must accept and speak of cookies.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    n = F.row_number().over(Window.partitionBy("page", "tier").orderBy("seq"))
    fits = (
        F.when(F.col("tier") == 1, urls.any_of(low("text"), rules.COOKIE_ACCEPT_TOKENS) & urls.any_of(low("text"), rules.COOKIE_CONTEXT_TOKENS))
        .when(F.col("tier") == 2, urls.any_of(low("aria_label"), ["accept", "cookie", "consent"]))
        .otherwise(True)
    )
    good = handles.withColumn("n", n).where((F.col("n") <= looked_at) & F.col("clickable") & fits)
    return good.groupBy("page").agg(F.min(F.struct("tier", "seq")).alias("c")).select("page", "c.tier", "c.seq")


def public_fallback(candidates: DataFrame, scan: tuple[str, ...] = ("seed",)) -> DataFrame:
    """(seed, url, kind) of the page to use where a seed needs a login.

    ``candidates`` has seed, pos, url and html of fetched fallback pages.  The
    first with more than 40 characters and no login wall, else the last with
    more than 40, else none.  ``scan`` names the columns that tell one scan from
    another, and the result has them in place of seed; seeds that are scanned
    more than once need an id besides.
    """
    rows = candidates.withColumn("long", F.char_length(F.coalesce("html", F.lit(""))) > 40)
    rows = rows.withColumn("open", F.col("long") & (html.login_wall(F.col("html"), F.col("url")) == "none"))
    best = rows.groupBy(*scan).agg(F.min(F.when(F.col("open"), F.struct("pos", "url"))).alias("first"), F.max(F.when(F.col("long"), F.struct("pos", "url"))).alias("last"))
    return best.select(
        *scan,
        F.coalesce("first.url", "last.url").alias("url"),
        F.when(F.col("first").isNotNull(), "public").when(F.col("last").isNotNull(), "partial").otherwise("none").alias("kind"),
    )


def fallback_candidates(seeds: DataFrame) -> DataFrame:
    """(seed, pos, url) of the public pages to try for each seed, with the other columns of ``seeds``."""
    return seeds.select(*[c for c in seeds.columns if c != "url"], F.col("url").alias("seed"), F.posexplode(requests.fallback_urls(F.col("url"))).alias("pos", "url"))


def bfs_baseline(fetches: DataFrame) -> DataFrame:
    """Cost of a plain breadth-first crawl: (site, requests, failed, blocked, bytes, templates).

    ``fetches`` has site, url, status and html, a row for each request; a URL may
    be asked for more than once, and each time counts by its own answer.  A
    page that did not answer 200 gives no bytes, one without answer has a null
    status; 403, 429 and 503 count as blocked.
    """
    good = F.coalesce(F.col("status") == 200, F.lit(False))
    return fetches.groupBy("site").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(~good).alias("failed"),
        F.count_if(F.col("status").isin(403, 429, 503)).alias("blocked"),
        F.coalesce(F.sum(F.when(good, F.octet_length("html"))), F.lit(0)).alias("bytes"),
        F.count_distinct(urls.template_signal(F.coalesce("url", F.lit("")))).alias("templates"),
    )
