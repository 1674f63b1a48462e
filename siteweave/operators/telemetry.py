"""Audit events: assembly, windows, alerts and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import failures, urls
from . import scoring

WINDOW = 1000
MODES = ["fast", "deep", "max"]


def last_events(events: DataFrame, n: int = WINDOW) -> DataFrame:
    """The n latest events: a top-k, kept per partition before the merge."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(max(10, n))


def _rate(condition: Column) -> Column:
    return F.round(F.coalesce(F.avg(F.when(condition, 1.0).otherwise(0.0)), F.lit(0.0)), 6)


def _rates() -> list[Column]:
    return [
        _rate(F.col("timeout")).alias("timeout_rate"),
        _rate(F.col("degraded_mode")).alias("degraded_rate"),
        F.round(F.coalesce(F.avg(F.coalesce("fallback_rate", F.lit(0.0))), F.lit(0.0)), 6).alias("enrichment_fallback_rate"),
    ]


def alert_snapshot(events: DataFrame, n: int = WINDOW) -> DataFrame:
    """Rates over the last n events; zeros where there is none."""
    return last_events(events, n).agg(*_rates())


def hit_rate(counters: Column, prefix: str) -> Column:
    """Share of hits among the hits and misses of a counter map."""
    get = lambda k: F.coalesce(F.try_element_at(counters, F.lit(f"{prefix}_{k}")), F.lit(0))
    return urls.safe_ratio(get("hits"), get("hits") + get("misses"))


TIERS = ["page", "dom", "llm", "fix"]
GAUGES = ["crawler_sitemap_success_rate", "crawler_discovery_fallback_rate"]


def metrics(events: DataFrame, n: int = WINDOW, counters: DataFrame | None = None, gauges: dict[str, float] | None = None) -> DataFrame:
    """(metric, label, value): times by mode of the last n events, rates, cache hits by tier, gauges.

    ``counters`` has name (a tier with _hits or _misses) and value, summed if
    repeated; without it all hit rates are 0, as are gauges that are not given.
    """
    spark = events.sparkSession
    last = last_events(events, n).withColumn("mode", F.lower(F.coalesce("scan_mode", F.lit("fast"))))
    by_mode = (
        last.where(F.col("mode").isin(MODES))
        .groupBy("mode")
        .agg(
            F.percentile("duration_ms", 0.5).alias("audit_duration_p50_ms"),
            F.percentile("duration_ms", 0.95).alias("audit_duration_p95_ms"),
            F.percentile("pages_audited", 0.5).alias("pages_per_audit_p50"),
        )
    )
    names = ["audit_duration_p50_ms", "audit_duration_p95_ms", "pages_per_audit_p50"]
    modes = spark.createDataFrame([(m,) for m in MODES], "mode string")
    full = modes.join(by_mode, "mode", "left").select(F.col("mode").alias("label"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])
    rows = full.unpivot("label", names, "metric", "value")
    rates = last.agg(*_rates(), _rate(F.lower("enrichment_status") == "complete").alias("enrichment_completion_rate"))
    flat = rates.select(F.lit("").alias("label"), "*").unpivot("label", rates.columns, "metric", "value")
    if counters is None:
        counters = spark.createDataFrame([], "name string, value long")
    sums = {f"{t}_{k}": F.coalesce(F.sum(F.when(F.col("name") == f"{t}_{k}", F.col("value"))), F.lit(0)) for t in TIERS for k in ("hits", "misses")}
    held = counters.agg(F.create_map(*[x for k, v in sums.items() for x in (F.lit(k), v)]).alias("counters"))
    tiers = held.select(F.lit("cache_hit_rate").alias("metric"), F.explode(F.array(*map(F.lit, TIERS))).alias("label"), "counters")
    cached = tiers.select("metric", "label", _tier_rate().alias("value"))
    given = gauges or {}
    gauge = spark.createDataFrame([(g, "", float(given.get(g, 0.0))) for g in GAUGES], "metric string, label string, value double")
    shown = rows.unionByName(flat).unionByName(cached).unionByName(gauge)
    return shown.select("metric", "label", F.round("value", 6).alias("value"))


def _tier_rate() -> Column:
    rate = F.lit(0.0)
    for tier in TIERS:
        rate = F.when(F.col("label") == tier, hit_rate(F.col("counters"), tier)).otherwise(rate)
    return rate


def exposition(rows: DataFrame, prefix: str = "siteweave") -> DataFrame:
    """Text lines of the metrics; values by mode with two decimals, others with six."""
    by_mode = F.col("label").isin(MODES)
    kind = F.when(by_mode, F.lit("mode")).otherwise(F.lit("tier"))
    label = F.when(F.col("label") != "", F.concat(F.lit("{"), kind, F.lit('="'), "label", F.lit('"}'))).otherwise("")
    shown = F.when(by_mode, F.format_string("%.2f", "value")).otherwise(F.format_string("%.6f", "value"))
    return rows.select(F.concat_ws(" ", F.concat(F.lit(prefix + "_"), "metric", label), shown).alias("line"))


def bursts(events: DataFrame, seconds: int) -> DataFrame:
    """Failures within the last ``seconds`` up to each failure, both ends included.

    A range window per hour of overlap: rows are dealt by the hour they fall in
    and the one after, so no task holds the whole stream.
    """
    width = max(1, int(seconds))
    span = max(3600, 2 * width)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    hits = events.where("timeout").select("event_id", us.alias("us"))
    slot = F.floor(F.col("us") / (span * 1_000_000))
    copies = hits.withColumn("own", slot).withColumn("slot", F.explode(F.array(slot, slot + 1)))
    frame = Window.partitionBy("slot").orderBy("us").rangeBetween(-width * 1_000_000, 0)
    return copies.withColumn("failures", F.count(F.lit(1)).over(frame)).where("own = slot").select("event_id", "failures")


#: Fields of an audit's result that may be missing, and what they are then.
RESULT_DEFAULTS = {
    "audit_id": ("string", ""),
    "status": ("string", "completed"),
    "url": ("string", ""),
    "scan_mode": ("string", "fast"),
    "pages_discovered": ("int", 1),
    "pages_audited": ("int", 1),
    "seconds": ("double", 0.0),
    "degraded_mode": ("boolean", False),
    "score": ("double", 0.0),
    "overall_score": ("double", None),
    "total_issues": ("long", 0),
    "enrichment_status": ("string", "complete"),
    "engines_used": ("array<string>", None),
    "quality_gates": ("map<string,boolean>", None),
    "cache_counters": ("map<string,long>", None),
    "summary": ("string", ""),
    "degraded_reason": ("string", ""),
    "degradation_reason": ("string", ""),
    "ts": ("timestamp", None),
}


def audit_events(results: DataFrame, signals: DataFrame) -> DataFrame:
    """One row for each audit: its own fields and its issues' breakdowns.

    ``results`` has site and any of RESULT_DEFAULTS; empty fields and fields
    that are missing take the default.  ``signals`` is as for the breakdowns.
    An audit timed out if its gate runtime_passed is false or its summary says
    so.  A degraded audit without reason gets the class of its summary.
    """
    field = lambda k: F.col(k) if k in results.columns else F.lit(None)
    filled = {}
    for name, (kind, default) in RESULT_DEFAULTS.items():
        value = field(name).cast(kind)
        if kind in ("int", "double", "long") and default:
            value = F.when(value != 0, value)
        if kind == "string" and default:
            value = F.when(value != "", value)
        if kind.startswith(("array", "map")):
            default_value = F.array().cast(kind) if kind.startswith("array") else F.create_map().cast(kind)
            filled[name] = F.coalesce(value, default_value)
        else:
            filled[name] = value if default is None else F.coalesce(value, F.lit(default))
    out = results.select("site", *[v.alias(k) for k, v in filled.items()])
    parts = [
        scoring.severity_breakdown(signals).withColumnsRenamed({"critical": "critical_issues", "major": "major_issues", "minor": "minor_issues"}),
        scoring.enrichment_breakdown(signals).withColumnRenamed("fallback_rate", "enrichment_fallback_rate"),
        scoring.priority_distribution(signals).withColumnsRenamed({k: f"priority_{k}" for k in ("min", "p50", "p95", "max", "avg")}),
        scoring.top_issue_types(signals)
        .groupBy("site")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "issue_type", "count"))), lambda x: F.struct(x["issue_type"].alias("issue_type"), x["count"].alias("count"))).alias("top_issue_types")),
    ]
    for part in parts:
        out = out.join(part, "site", "left")
    summary = F.lower("summary")
    late = ~F.coalesce(F.try_element_at("quality_gates", F.lit("runtime_passed")), F.lit(True)) | summary.contains("timed out")
    said = F.when(F.col("degraded_reason") != "", F.col("degraded_reason")).when(
        F.col("degraded_mode"), F.coalesce(F.nullif("degradation_reason", F.lit("")), "summary")
    )
    overall = F.coalesce(F.when(F.col("overall_score") != 0, F.col("overall_score")), F.col("score"))
    zero = F.lit(0.0)
    scores = F.struct(
        F.col("score").alias("overall_score"), zero.alias("critical_penalty"), zero.alias("major_penalty"), zero.alias("minor_penalty"), F.col("total_issues").alias("issue_count")
    )
    return out.select(
        "site", "audit_id", F.coalesce("ts", F.current_timestamp()).alias("timestamp"), F.lit("audit").alias("event_type"), "status", "url", "scan_mode",
        "pages_discovered", "pages_audited", F.col("seconds").alias("scan_time_seconds"), (F.col("seconds") * 1000).cast("long").alias("total_duration_ms"),
        "degraded_mode", late.alias("timeout"), F.col("score").alias("site_score"), overall.alias("overall_score"), "total_issues",
        F.when(said.isNull(), "").otherwise(failures.normalize_failure(said)).alias("degraded_reason"),
        "critical_issues", "major_issues", "minor_issues", scores.alias("score_distribution"), scores.alias("overall_score_distribution"),
        *[f"priority_{k}" for k in ("min", "p50", "p95", "max", "avg")], "top_issue_types", "enrichment_status",
        *[*scoring.ENRICHMENT, "other"], "enrichment_fallback_rate", "engines_used", "quality_gates", "cache_counters",
    )
