"""Site topology: structural segments, templates, labels and samples.

Every operator takes rows of many sites and keys them by ``site``.  The cap on
URLs per site is applied in two steps, first per salt, so a site with a third
of all rows never meets in one task before it is cut to the cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, urls

SALTS = 32


def first_seen(rows: DataFrame) -> DataFrame:
    """Distinct URLs of each site, each at its first position."""
    return rows.groupBy("site", "url").agg(F.min("pos").alias("pos"))


def capped(rows: DataFrame, cap: int = rules.TOPOLOGY_CAP) -> DataFrame:
    """The first ``cap`` URLs of each site by position."""
    salt = F.pmod(F.xxhash64("url"), F.lit(SALTS))
    part = Window.partitionBy("site", "salt").orderBy("pos", "url")
    whole = Window.partitionBy("site").orderBy("pos", "url")
    near = rows.withColumn("salt", salt).withColumn("n", F.row_number().over(part)).where(F.col("n") <= cap)
    return near.withColumn("n", F.row_number().over(whole)).where(F.col("n") <= cap).drop("salt", "n")


def _parts(path: Column) -> Column:
    """Segments between the outer slashes; inner empty ones keep their place."""
    return F.split(F.btrim(path, F.lit("/")), "/")


def structural_segments(rows: DataFrame) -> DataFrame:
    """(site, place, segment, share) of segments on at least 30 % of a site's paths.

    ``rows`` has site and path, one row for each URL.
    """
    totals = rows.groupBy("site").agg(F.count(F.lit(1)).alias("paths"))
    counts = (
        rows.select("site", F.posexplode(_parts(F.col("path"))).alias("place", "segment"))
        .where("segment <> ''")
        .groupBy("site", "place", "segment")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    share = F.col("n").cast("double") / F.col("paths")
    return counts.join(totals, "site").withColumn("share", share).where(F.col("share") >= F.lit(rules.STRUCTURAL_SHARE)).drop("n", "paths")


def template(path: Column, structural: Column) -> Column:
    """Path with all but structural segments replaced by their kind.

    ``structural`` is an array of (place, segment) structs.
    """
    def one(s: Column, i: Column) -> Column:
        kept = F.exists(structural, lambda x: (x["place"] == i) & (x["segment"] == s))
        return (
            F.when(s == "", F.lit(None))
            .when(kept, s)
            .when(s.rlike("^[0-9]+$"), "{id}")
            .when(s.rlike(rules.SEGMENT_UUID), "{uuid}")
            .otherwise("{slug}")
        )

    return F.concat(F.lit("/"), F.array_join(F.filter(F.transform(_parts(path), one), lambda x: x.isNotNull()), "/"))


def with_templates(rows: DataFrame) -> DataFrame:
    """Adds template to rows of site, url, pos; paginated URLs have none."""
    rows = rows.withColumn("path", urls.path(F.col("url"))).withColumn("paginated", urls.is_paginated(F.col("url")))
    plain = rows.where("not paginated")
    kept = structural_segments(plain).groupBy("site").agg(F.collect_set(F.struct("place", "segment")).alias("structural"))
    none = F.array().cast("array<struct<place:int,segment:string>>")
    return rows.join(kept, "site", "left").withColumn(
        "template", F.when(~F.col("paginated"), template(F.col("path"), F.coalesce("structural", none)))
    ).drop("structural")


def _label(urls_: Column, templates: Column, largest: Column, plain: Column, paginated: Column) -> Column:
    return (
        F.when(urls_ == 1, "single_page")
        .when((urls.safe_ratio(largest, plain) >= 0.50) & (plain > 20), "deep_uniform")
        .when(urls.safe_ratio(paginated, urls_) > 0.10, "paginated")
        .when(templates >= 3, "multi_template")
        .otherwise("thin")
    )


def site_labels(rows: DataFrame, rendered: Column | None = None) -> DataFrame:
    """(site, topology, urls, templates_found, paginated) from rows with templates.

    ``rendered`` is the number of routes a renderer confirmed; a site of one
    URL is a single page only if it is at most one.
    """
    groups = rows.groupBy("site", "template", "paginated").agg(F.count(F.lit(1)).alias("n"))
    sums = groups.groupBy("site").agg(
        F.sum("n").alias("urls"),
        F.coalesce(F.sum(F.when(~F.col("paginated"), F.col("n"))), F.lit(0)).alias("plain"),
        F.coalesce(F.sum(F.when(F.col("paginated"), F.col("n"))), F.lit(0)).alias("paginated"),
        F.coalesce(F.max(F.when(~F.col("paginated"), F.col("n"))), F.lit(0)).alias("largest"),
        F.count_if(~F.col("paginated")).alias("templates"),
    )
    one = F.col("urls") == 1 if rendered is None else (F.col("urls") == 1) & (rendered <= 1)
    label = _label(F.when(one, 1).otherwise(F.greatest("urls", F.lit(2))), F.col("templates"), F.col("largest"), F.col("plain"), F.col("paginated"))
    return sums.select("site", label.alias("topology"), "urls", F.when(one, 1).otherwise(F.col("templates")).alias("templates_found"), "paginated")


def samples(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(site, template, group_size, choice, url, pos): the URLs chosen of each template.

    Small sites' groups are bounded by the cap, so the windows are too.
    """
    quota = F.element_at(F.create_map(*[F.lit(x) for pair in rules.TOPOLOGY_QUOTA.items() for x in pair]), F.col("topology"))
    order = [
        F.when(urls.query(F.col("url")) != "", 1).otherwise(0),
        F.size(_parts(F.col("path"))),
        F.char_length("url"),
        F.col("pos"),
        F.col("url"),
    ]
    group = Window.partitionBy("site", "template")
    return (
        rows.where("not paginated")
        .withColumn("group_size", F.count(F.lit(1)).over(group))
        .withColumn("choice", F.row_number().over(group.orderBy(*order)))
        .join(labels.select("site", "topology"), "site")
        .where(F.col("choice") <= quota)
        .select("site", "template", "group_size", "choice", "url", "pos")
    )


def detect_topology(rows: DataFrame) -> DataFrame:
    """One row for each site: its label, counts and the URLs to crawl.

    ``rows`` has site, pos and url; the same URL may stand at many positions.
    """
    unique = first_seen(rows)
    totals = unique.groupBy("site").agg(F.count(F.lit(1)).alias("total_discovered"))
    named = with_templates(capped(unique))
    labels = site_labels(named)
    chosen = samples(named, labels).groupBy("site").agg(
        F.count(F.lit(1)).alias("chosen"),
        F.array_sort(F.collect_list(F.struct((-F.col("group_size")).alias("size"), "template", "choice", "url"))).alias("picked"),
    )
    homes = named.where(urls.is_homepage(F.col("url"))).groupBy("site").agg(F.min_by("url", "pos").alias("homepage"))
    firsts = named.groupBy("site").agg(F.min_by("url", "pos").alias("first"))
    joined = labels.join(totals, "site").join(chosen, "site", "left").join(homes, "site", "left").join(firsts, "site")
    none = F.array().cast("array<string>")
    picked = F.coalesce(F.transform("picked", lambda x: x["url"]), none)
    rest = F.filter(picked, lambda u: u != F.coalesce(F.col("homepage"), F.lit("")))
    crawl = F.when(F.col("homepage").isNotNull(), F.concat(F.array("homepage"), rest)).otherwise(picked)
    single = F.col("topology") == "single_page"
    return joined.select(
        "site",
        "topology",
        "templates_found",
        "total_discovered",
        F.when(single, F.col("paginated")).otherwise(F.col("urls") - F.coalesce("chosen", F.lit(0))).alias("skipped_urls"),
        F.when(single, F.array(F.coalesce("homepage", "first"))).otherwise(crawl).alias("crawl_urls"),
    )
