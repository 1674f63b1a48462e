"""Stop and budget rules over recorded crawls, as windows and bounded folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, urls


def info_gain(log: DataFrame, window: int = 3, threshold: float = 0.05, min_pages: int = 4) -> DataFrame:
    """Rows with the gain after each page and the page at which a site's crawl stops.

    ``log`` has site, ord, fetch_status and signal.  Only successes add to the
    window, but the rule is checked after every page.
    """
    by_site = Window.partitionBy("site").orderBy("ord")
    good = F.col("fetch_status") == "success"
    first = F.row_number().over(Window.partitionBy("site", good, "signal").orderBy("ord")) == 1
    rows = log.withColumn("new", F.when(good & first, 1).otherwise(0)).withColumn("seen", F.sum(F.when(good, 1).otherwise(0)).over(by_site))
    # successes by their own count: the window is over the last ones, wherever the failures stand
    wins = rows.where(good).withColumn("recent", F.sum("new").over(Window.partitionBy("site").orderBy("ord").rowsBetween(1 - window, 0)))
    wins = wins.withColumn("total", F.sum("new").over(by_site)).select("site", "seen", "recent", "total")
    out = rows.join(wins, ["site", "seen"], "left").withColumn(
        "gain", F.when(F.col("seen") >= window, F.col("recent") / F.greatest("total", F.lit(1)).cast("double"))
    )
    stops = F.min(F.when((F.col("ord") >= min_pages) & (F.col("gain") < F.lit(threshold)), F.col("ord"))).over(Window.partitionBy("site"))
    return out.withColumn("stop_ord", stops).select("site", "ord", "new", "total", F.round("gain", 6).alias("gain"), "stop_ord")


def failure_runs(log: DataFrame) -> DataFrame:
    """Length of the run of failures that ends at each page, and the running rates."""
    by_site = Window.partitionBy("site").orderBy("ord")
    bad = F.col("fetch_status") != "success"
    grouped = log.withColumn("island", F.sum(F.when(bad, 0).otherwise(1)).over(by_site))
    run = F.sum(F.when(bad, 1).otherwise(0)).over(Window.partitionBy("site", "island").orderBy("ord"))
    failed = F.sum(F.when(bad, 1).otherwise(0)).over(by_site)
    return grouped.select(
        "site",
        "ord",
        run.alias("run"),
        failed.alias("failed"),
        F.round(failed / F.col("ord").cast("double"), 6).alias("failure_rate"),
        # durations are whole milliseconds, so their sums are exact
        F.round(F.sum(F.round(F.col("duration_s") * 1000).cast("long")).over(by_site) / F.col("ord") / 1000.0, 9).alias("mean_duration"),
    )


def adaptive_budget(
    log: DataFrame, max_pages: int, rate: float = 0.30, seconds: float = 4.0, ratio: float = 0.40, min_pages: int = 3
) -> DataFrame:
    """Budget left by the reductions of a crawl: (site, pages, effective_max_pages, reductions).

    Only the first ``max_pages`` pages of a site can be crawled, so the fold
    over a site is bounded by the budget.
    """
    top = log.where(F.col("ord") <= max_pages)
    bad = F.when(F.col("fetch_status") == "success", 0).otherwise(1)
    pages = top.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("ord", bad.alias("bad"), "duration_s"))).alias("pages"))
    start = F.struct(
        F.lit(0).alias("n"), F.lit(0).alias("bad"), F.lit(0.0).alias("time"), F.lit(max_pages).alias("budget"), F.lit(0).alias("cuts")
    )

    def step(s, x):
        n, bad_n, time = s["n"] + 1, s["bad"] + x["bad"], s["time"] + x["duration_s"]
        left = F.greatest(F.lit(0), s["budget"] - n)
        kept = n + F.greatest(F.lit(1), F.bround(left * F.lit(1.0 - ratio), 0).cast("int"))
        slow = (bad_n / n.cast("double") > F.lit(rate)) | (time / n.cast("double") > F.lit(seconds))
        cut = (n >= min_pages) & slow & (left > 1) & (kept < s["budget"])
        nxt = F.struct(
            n.alias("n"), bad_n.alias("bad"), time.alias("time"), F.when(cut, kept).otherwise(s["budget"]).alias("budget"), (s["cuts"] + F.when(cut, 1).otherwise(0)).alias("cuts")
        )
        return F.when(s["n"] >= s["budget"], s).otherwise(nxt)

    end = F.aggregate("pages", start, step)
    return pages.select("site", end.alias("e")).select(
        "site", F.col("e.n").alias("pages"), F.col("e.budget").alias("effective_max_pages"), F.col("e.cuts").alias("reductions")
    )


def reflection(crawls: DataFrame) -> DataFrame:
    """Efficiency and advice for crawls with pages_crawled, unique_signals and pages_failed."""
    efficiency = urls.safe_ratio(F.col("unique_signals"), F.col("pages_crawled"))
    failed = urls.safe_ratio(F.col("pages_failed"), F.col("pages_crawled"))
    advice = (
        F.when(failed > 0.2, rules.ADVICE["failures"])
        .when((efficiency < 0.1) & (F.col("pages_crawled") > 5), rules.ADVICE["low_gain"])
        .otherwise(rules.ADVICE["none"])
    )
    return crawls.withColumns({"intelligence_score": F.round(efficiency, 3), "failure_rate": F.round(failed, 3), "advice": advice})
