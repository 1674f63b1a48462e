"""Robots files and sitemaps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, urls
from ..sources.scratch import written

#: Agents whose rules hold; a deployment adds its own product tokens.
AGENTS = ("*",)


def _lines(robots: DataFrame) -> DataFrame:
    lines = robots.select("site", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|[\n\r\x0B\f\u0085  ]")).alias("line", "raw"))
    return lines.withColumn("raw", F.trim("raw"))


def _after_colon(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, "^[^:]*:", ""))


def disallowed_prefixes(robots: DataFrame, agents: tuple[str, ...] = AGENTS) -> DataFrame:
    """(site, prefix) of the paths closed to ``agents``.

    The last agent line above a rule decides, so of stacked agent lines only
    the last counts.
    """
    lines = _lines(robots).where((F.col("raw") != "") & ~F.col("raw").startswith("#"))
    low = F.lower("raw")
    own = F.when(low.startswith("user-agent:"), F.lower(_after_colon(F.col("raw"))).isin(list(agents)))
    carried = F.last(own, ignorenulls=True).over(Window.partitionBy("site").orderBy("line"))
    return (
        lines.withColumn("own", F.coalesce(carried, F.lit(False)))
        .where("own")
        .where(low.startswith("disallow:"))
        .select("site", _after_colon(F.col("raw")).alias("prefix"))
        .where("prefix <> ''")
        .distinct()
    )


def allowed(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rows (site, url, ...) whose path starts with none of the site's prefixes.

    A site's prefixes are one small array, joined by site.
    """
    lists = prefixes.groupBy("site").agg(F.collect_set("prefix").alias("_closed"))
    joined = rows.join(lists, "site", "left")
    return joined.where(F.col("_closed").isNull() | ~urls.is_disallowed(F.col("url"), F.col("_closed"))).drop("_closed")


def sitemap_locations(sites: DataFrame, robots: DataFrame) -> DataFrame:
    """(site, pos, sitemap_url): from robots lines, or the usual places where there are none.

    ``sites`` has site and origin.
    """
    base = F.concat("origin", F.lit("/"))
    lines = _lines(robots).where(F.lower("raw").startswith("sitemap:")).select("site", "line", _after_colon(F.col("raw")).alias("target")).where("target <> ''")
    named = lines.join(sites, "site").select("site", F.col("line").alias("pos"), urls.resolve(base, F.col("target")).alias("sitemap_url"))
    fallback = sites.join(named.select("site").distinct(), "site", "left_anti").select(
        "site", F.posexplode(F.transform(F.array(*map(F.lit, rules.SITEMAP_FALLBACKS)), lambda p: F.concat("origin", p))).alias("pos", "sitemap_url")
    )
    both = named.unionByName(fallback)
    first = both.groupBy("site", urls.normalize(F.col("sitemap_url")).alias("_n")).agg(F.min(F.struct("pos", "sitemap_url")).alias("f"))
    return first.select("site", "f.pos", "f.sitemap_url")


ENTRY = "struct<loc:string,priority:string,changefreq:string,lastmod:string>"


def parsed(documents: DataFrame) -> DataFrame:
    """Adds kind (sitemapindex, urlset or null) and entries to rows with an xml column.

    A document that is not well formed has neither, as a parser that gives up
    leaves nothing.  Namespaces are ignored.
    """
    import xml.etree.ElementTree as ET

    local = lambda tag: tag.rsplit("}", 1)[-1]
    fields = ["loc", "priority", "changefreq", "lastmod"]

    def read(text: str | None):
        # entity definitions are refused, so a document cannot expand
        if not text or "<!ENTITY" in text:
            return None, None
        try:
            root = ET.fromstring(text)
        except ET.ParseError:
            return None, None
        kind = local(root.tag)
        wanted = {"sitemapindex": "sitemap", "urlset": "url"}.get(kind)
        if wanted is None:
            return None, None
        out = []
        for node in root:
            if local(node.tag) != wanted:
                continue
            got = {}
            for child in node:
                name = local(child.tag)
                if name in fields and name not in got:
                    got[name] = (child.text or "").strip() or None
            if got.get("loc"):
                out.append({f: got.get(f) for f in fields})
        return kind, out

    entry = pa.list_(pa.struct([(f, pa.string()) for f in fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read(x.as_py()) for x in batch.column("xml")]
            rest = [c for c in batch.schema.names if c != "xml"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in rest], pa.array([k for k, _ in found], pa.string()), pa.array([e for _, e in found], entry)], [*rest, "kind", "entries"]
            )

    rest = [f for f in documents.schema.fields if f.name != "xml"]
    return documents.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + f", kind string, entries array<{ENTRY}>")


def sitemap_urls(locations: DataFrame, documents: DataFrame, prefixes: DataFrame, cap: int = rules.SITEMAP_CAP) -> DataFrame:
    """(site, url, priority, changefreq, lastmod, depth, place) of each site's sitemaps.

    ``locations`` has site, pos and sitemap_url; ``documents`` url and xml.
    Indexes are followed level by level for all sites at once, SITEMAP_DEPTH
    levels at most; a sitemap already read is not read again.
    """
    docs = written(parsed(documents.select(urls.normalize(F.col("url")).alias("key"), "xml")))
    level = locations.select("site", F.array("pos").alias("path"), "sitemap_url", urls.normalize(F.col("sitemap_url")).alias("key"))
    seen, found = None, None
    for _ in range(rules.SITEMAP_DEPTH):
        once = level.groupBy("site", "key").agg(F.min(F.struct("path", "sitemap_url")).alias("f")).select("site", "key", "f.path", "f.sitemap_url")
        fresh = written(once if seen is None else once.join(seen, ["site", "key"], "left_anti"))
        if fresh.isEmpty():
            break
        seen = fresh.select("site", "key") if seen is None else seen.unionByName(fresh.select("site", "key"))
        read = fresh.join(docs, "key")
        entries = read.where("kind = 'urlset'").select("site", "path", F.posexplode("entries").alias("n", "e"))
        found = entries if found is None else found.unionByName(entries)
        level = read.where("kind = 'sitemapindex'").select("site", "path", "sitemap_url", F.posexplode("entries").alias("n", "e"))
        target = urls.resolve(F.col("sitemap_url"), F.col("e.loc"))
        level = level.select("site", F.concat("path", F.array("n")).alias("path"), target.alias("sitemap_url"), urls.normalize(target).alias("key"))
    origin = F.col("site")
    # each URL step is written: filters pushed into the next would repeat its expressions many times over
    rows = written(found.withColumn("absolute", urls.resolve(F.concat(origin, F.lit("/")), F.col("e.loc"))))
    rows = rows.where((urls.origin(F.col("absolute")) == origin) & ~urls.has_binary_extension(F.col("absolute")))
    rows = allowed(written(rows.withColumn("url", urls.normalize(F.col("absolute")))), prefixes)
    base = urls.clamp(urls.safe_double(F.col("e.priority"), rules.DEFAULT_PRIORITY), 0.0, 1.0)
    rows = rows.select(
        "site",
        "url",
        urls.clamp(base + urls.priority_boost(F.col("absolute")), 0.0, 1.0).alias("priority"),
        F.coalesce("e.changefreq", F.lit("unknown")).alias("changefreq"),
        F.col("e.lastmod").alias("lastmod"),
        urls.depth(F.col("url")).alias("depth"),
        "path",
        "n",
    )
    best = rows.groupBy("site", "url").agg(F.min(F.struct((-F.col("priority")).alias("p"), "depth", "path", "n", "priority", "changefreq", "lastmod")).alias("b"))
    best = best.select("site", "url", "b.priority", "b.changefreq", "b.lastmod", "b.depth")
    order = Window.partitionBy("site").orderBy(F.desc("priority"), "depth", "url")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)
