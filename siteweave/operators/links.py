"""Link extraction and selection for many pages at once."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, rules, urls
from ..sources.scratch import written


def page_links(pages: DataFrame, exact: bool = False) -> DataFrame:
    """(page_id, url, pos, href, text, in_nav, in_header_footer) of every anchor.

    The tokeniser runs in the JVM; ``exact`` parses with the standard library.
    """
    if exact:
        found = pages.select("page_id", "url", "html").join(html.exact_anchors(pages), "page_id")
    else:
        found = pages.select("page_id", "url", html.anchors(F.col("html")).alias("anchors"))
    return found.select("page_id", "url", F.posexplode("anchors").alias("pos", "a")).select("page_id", "url", "pos", "a.*")


def cleaned(links: DataFrame) -> DataFrame:
    """Links with trimmed hrefs and collapsed texts; blank hrefs go."""
    return links.withColumns({"href": F.trim("href"), "text": html.collapsed(F.coalesce("text", F.lit("")))}).where("href <> ''")


def skip_reason(url: Column, seed_host: Column, depth: Column, sampling: bool = True) -> Column:
    """Why a link is not followed, or null; the first rule that fits decides."""
    low, p = F.lower(F.trim(url)), F.lower(urls.path(url))
    keys = F.transform(urls.query_pairs(urls.query(url)), lambda x: F.lower(x["k"]))
    has = lambda *names: F.arrays_overlap(keys, F.array(*map(F.lit, names)))
    ends = "(?:" + "|".join(re.escape(e) for e in rules.EXCLUDED_EXTENSIONS) + ")$"
    starts = "^(?:" + "|".join(re.escape(s) for s in rules.EXCLUDED_SCHEMES) + ")"
    out = (
        F.when((low == "") | low.rlike(starts), "exclusion_rule")
        .when(~urls.scheme(url).isin("http", "https") | (urls.host(url) == ""), "exclusion_rule")
        .when(urls.host(url) != seed_host, "external")
        .when(p.rlike(ends), "exclusion_rule")
    )
    if not sampling:
        return out
    return (
        out.when(p.rlike(rules.LOW_VALUE_PATH), "low_value_pattern")
        .when((depth > 1) & p.rlike(rules.PAGED_PATH), "exclusion_rule")
        .when(has("page", "filter", "sort"), "low_value_pattern")
        .when((depth > 1) & has("page", "offset", "cursor"), "exclusion_rule")
        .when((depth > 2) & p.rlike(rules.ARCHIVE_PATH), "exclusion_rule")
    )


def page_class(url: Column, text: Column, in_nav: Column, in_header_footer: Column) -> Column:
    """(page_type, page_weight, tier) of a link."""
    u, t = F.lower(url), F.lower(html.collapsed(F.coalesce(text, F.lit(""))))
    kind = lambda name, weight, tier: F.struct(F.lit(name).alias("page_type"), F.lit(weight).alias("page_weight"), F.lit(tier).alias("tier"))
    return (
        F.when(urls.any_of(u, rules.INTERACTION_URL_KEYWORDS) | urls.any_of(t, rules.INTERACTION_TEXT_KEYWORDS), kind("interaction", 0.9, 2))
        .when(in_nav | in_header_footer | u.contains("category") | u.contains("page"), kind("nav", 0.8, 3))
        .otherwise(kind("standard", 0.7, 4))
    )


def resolved_links(links: DataFrame) -> DataFrame:
    """Cleaned links with fetch_url, the absolute address of href on the page url."""
    return cleaned(links).withColumn("fetch_url", urls.resolve(F.col("url"), F.col("href")))


def judged_links(links: DataFrame, seed_host: Column, next_depth: Column, sampling: bool = True, resolved: bool = False) -> DataFrame:
    """Links with fetch_url, dedup_key, class and the reason they are skipped, if any.

    Addresses are resolved into a written table before they are judged: every
    rule reads the address, and in one plan each would resolve it again.
    ``resolved`` says that ``links`` are such a table already.
    """
    rows = links if resolved else written(resolved_links(links))
    rows = rows.withColumn("dedup_key", urls.dedup_key(F.col("fetch_url")))
    rows = rows.withColumn("class", page_class(F.col("fetch_url"), F.col("text"), F.col("in_nav"), F.col("in_header_footer")))
    reason = F.coalesce(
        skip_reason(F.col("fetch_url"), seed_host, next_depth, sampling),
        F.when(F.col("dedup_key") == "", "exclusion_rule"),
        F.when(F.lit(sampling) & (next_depth >= 2) & (F.col("class.page_type") == "standard"), "low_value_depth"),
    )
    return rows.withColumn("reason", reason)


def selected_links(judged: DataFrame, key: str = "page_id") -> DataFrame:
    """The best link of each page and dedup key: lowest tier, then fetch_url."""
    best = F.min(F.struct("class.tier", "fetch_url", "class.page_type", "class.page_weight"))
    return (
        judged.where("reason is null")
        .groupBy(key, "dedup_key")
        .agg(best.alias("b"))
        .select(key, "dedup_key", "b.fetch_url", "b.page_type", "b.page_weight", "b.tier")
    )


def skipped_links(judged: DataFrame, key: str = "page_id") -> DataFrame:
    return judged.where("reason is not null").select(key, F.col("fetch_url").alias("url"), "reason")
