"""Site scores, issue aggregation and breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls


def site_issues(signals: DataFrame) -> DataFrame:
    """First finding of each type and place of a site, with the counts before and after.

    ``signals`` has site, page_pos, sig_pos, type, selector and severity.  The
    first is a mergeable minimum, so no site is gathered.
    """
    keyed = signals.withColumns({"type": F.coalesce(F.nullif("type", F.lit("")), F.lit("unknown")), "location": F.coalesce("selector", F.lit(""))})
    first = F.min(F.struct("page_pos", "sig_pos", F.coalesce(F.nullif("severity", F.lit("")), F.lit("minor")).alias("severity")))
    found = keyed.groupBy("site", "type", "location").agg(first.alias("f"), F.count(F.lit(1)).alias("n"))
    return found.select("site", "type", "location", "f.severity", F.col("f.page_pos").alias("affected_page"), "n")


def issue_totals(issues: DataFrame) -> DataFrame:
    return issues.groupBy("site").agg(F.sum("n").alias("signals_before"), F.count(F.lit(1)).alias("signals_after"))


def success_score(pages: DataFrame) -> DataFrame:
    """Percentage of a site's pages that succeeded."""
    return pages.groupBy("site").agg(F.round(F.avg(F.when(F.col("audit_status") == "success", 100.0).otherwise(0.0)), 2).alias("score"))


def weighted_score(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """Mean score by page weight, less 2 for each critical issue up to 20; null without scores.

    A weight of zero or null counts as 0.7.
    """
    weight = F.when(F.coalesce("page_weight", F.lit(0.0)) == 0, 0.7).otherwise(F.col("page_weight"))
    good = (F.col("audit_status") == "success") & F.col("score").isNotNull()
    base = pages.groupBy("site").agg(
        F.sum(F.when(good, F.col("score") * weight)).alias("total"), F.sum(F.when(good, weight)).alias("weight")
    )
    critical = issues.groupBy("site").agg(F.count_if(F.lower("severity") == "critical").alias("critical"))
    penalty = F.least(2 * F.coalesce("critical", F.lit(0)), F.lit(20))
    return base.join(critical, "site", "left").select(
        "site", F.round(F.greatest(F.try_divide("total", "weight") - penalty, F.when(F.col("weight") > 0, 0.0)), 1).alias("score")
    )


def severity_class(severity: Column) -> Column:
    s = F.lower(F.coalesce(severity, F.lit("minor")))
    return F.when(s == "critical", "critical").when(s.isin("major", "serious"), "major").otherwise("minor")


def severity_breakdown(signals: DataFrame) -> DataFrame:
    c = severity_class(F.col("severity"))
    return signals.groupBy("site").agg(*[F.count_if(c == k).alias(k) for k in ("critical", "major", "minor")])


ENRICHMENT = ["llm", "llm_cache", "fix_cache", "rule_fallback"]


def enrichment_bucket(source: Column) -> Column:
    s = F.coalesce(source, F.lit("other"))
    s = F.when(s == "fix_library_cache", "fix_cache").when(s.startswith("rule_fallback"), "rule_fallback").otherwise(s)
    return F.when(s.isin(ENRICHMENT), s).otherwise("other")


def enrichment_breakdown(signals: DataFrame) -> DataFrame:
    b = enrichment_bucket(F.col("enrichment_source"))
    counts = signals.groupBy("site").agg(*[F.count_if(b == k).alias(k) for k in [*ENRICHMENT, "other"]], F.count(F.lit(1)).alias("n"))
    return counts.withColumn("fallback_rate", F.round(urls.safe_ratio(F.col("rule_fallback"), F.greatest("n", F.lit(1))), 6)).drop("n")


def priority_distribution(signals: DataFrame) -> DataFrame:
    s = F.coalesce(F.col("priority_score"), F.lit(0.0))
    return signals.groupBy("site").agg(
        F.round(F.min(s), 3).alias("min"),
        F.round(F.percentile(s, 0.5), 3).alias("p50"),
        F.round(F.percentile(s, 0.95), 3).alias("p95"),
        F.round(F.max(s), 3).alias("max"),
        F.round(F.avg(s), 3).alias("avg"),
    )


def top_issue_types(signals: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent types of each site; the counts are few before they are ranked."""
    counts = signals.groupBy("site", F.coalesce("type", F.lit("unknown")).alias("issue_type")).agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("count"), "issue_type"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def reduction_report(runs: DataFrame) -> DataFrame:
    """Savings of one crawl against another: site, base_pages, pages, base_s, s, templates and base_templates."""
    saved = lambda a, b: F.coalesce(F.try_divide((F.col(a) - F.col(b)) * 100.0, F.col(a)), F.lit(0.0))
    tpl = F.col("templates") - F.col("base_templates")
    pages = saved("base_pages", "pages")
    outcome = (
        F.when((pages >= 40) & (tpl >= 0), "ELITE")
        .when((pages >= 20) & (tpl >= 0), "PASS")
        .when(tpl > 0, "PASS")
        .when(pages >= 0, "STABLE")
        .otherwise("REGRESSED")
    )
    return runs.select(
        "site", F.round(pages, 1).alias("page_reduction"), F.round(saved("base_s", "s"), 1).alias("time_reduction"), tpl.alias("template_gain"), outcome.alias("outcome")
    )


def efficiency_report(runs: DataFrame) -> DataFrame:
    """Savings of one crawl against a plain one: site, base_ and own pages, requests and bytes.

    PASS saves pages, SAME needs as many, WEAK needs more; efficiency is the
    mean of the three savings in percent.
    """
    saved = lambda k: F.coalesce(F.try_divide((F.col(f"base_{k}") - F.col(k)) * 100.0, F.col(f"base_{k}")), F.lit(0.0))
    pages, asked, sent = saved("pages"), saved("requests"), saved("bytes")
    outcome = F.when(pages > 0, "PASS").when(pages == 0, "SAME").otherwise("WEAK")
    return runs.select(
        "site", F.round(pages, 1).alias("page_saving"), F.round(asked, 1).alias("request_saving"), F.round(sent, 1).alias("bandwidth_saving"),
        F.round((pages + asked + sent) / 3, 1).alias("efficiency"), outcome.alias("outcome"),
    )


def mean_efficiency(report: DataFrame) -> DataFrame:
    """The one row of a report's mean efficiency, 0 without sites."""
    return report.agg(F.round(F.coalesce(F.avg("efficiency"), F.lit(0.0)), 1).alias("mean_efficiency"))
