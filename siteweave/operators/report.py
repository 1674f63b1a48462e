"""Reports: graph of a crawl, extraction jobs, HTML page."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fill, stroke, stroke width and text colour by page type.
STYLES = {
    "homepage": ("#38bdf8", "#0ea5e9", 4, "#fff"),
    "standard": ("#1e293b", "#334155", 1, "#94a3b8"),
    "nav": ("#818cf8", "#6366f1", 2, "#fff"),
    "interaction": ("#c084fc", "#a855f7", 2, "#fff"),
}


def node_id(url: Column) -> Column:
    """Stable id of a node."""
    return F.concat(F.lit("node_"), F.substring(F.md5(url), 1, 12))


def label(url: Column) -> Column:
    """URL without its scheme and outer slashes; the last 27 letters of a long one."""
    clean = F.btrim(F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")), F.lit("/"))
    return F.when(F.char_length(clean) > 30, F.concat(F.lit("..."), F.right(clean, F.lit(27)))).otherwise(clean)


def nodes(pages: DataFrame) -> DataFrame:
    """(node, label, page_type, url) of pages with url and page_type."""
    return pages.select(node_id(F.col("url")).alias("node"), label(F.col("url")).alias("label"), F.coalesce("page_type", F.lit("standard")).alias("page_type"), "url").distinct()


def edges(pages: DataFrame) -> DataFrame:
    """(parent, child) node ids where the parent is among the pages."""
    known = pages.select(F.col("url").alias("parent_url")).distinct()
    joined = pages.where("parent_url is not null and parent_url <> url").join(known, "parent_url", "left_semi")
    return joined.select(node_id(F.col("parent_url")).alias("parent"), node_id(F.col("url")).alias("child")).distinct()


def mermaid_lines(pages: DataFrame) -> DataFrame:
    """(section, pos, line) of a flowchart; in order they are the chart's text."""
    spark = pages.sparkSession
    head = ["graph TD", *[f"    classDef {k} fill:{a},stroke:{b},stroke-width:{w}px,color:{c};" for k, (a, b, w, c) in STYLES.items()]]
    top = spark.createDataFrame([(0, f"{i:03d}", x) for i, x in enumerate(head)], "section int, pos string, line string")
    n = nodes(pages)
    box = F.concat(F.lit("    "), "node", F.lit('["'), "label", F.lit("<br/><small>"), F.upper("page_type"), F.lit('</small>"]'))
    kind = F.concat(F.lit("    class "), "node", F.lit(" "), "page_type")
    tip = F.concat(F.lit("    click "), "node", F.lit(' callback "'), "url", F.lit('"'))
    body = n.select(F.lit(1).alias("section"), F.col("url").alias("pos"), F.posexplode(F.array(box, kind, tip)).alias("i", "line"))
    body = body.select("section", F.concat("pos", F.lit(" "), F.col("i").cast("string")).alias("pos"), "line")
    e = edges(pages).select(F.lit(2).alias("section"), F.concat("parent", "child").alias("pos"), F.concat(F.lit("    "), "parent", F.lit(" --> "), "child").alias("line"))
    return top.unionByName(body).unionByName(e)


def mermaid(pages: DataFrame, path: str | None = None) -> str:
    """Text of the chart of one crawl's pages, which a crawl's budget bounds."""
    text = "\n".join(r["line"] for r in mermaid_lines(pages).orderBy("section", "pos").collect())
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text


def jobs(summaries: DataFrame) -> DataFrame:
    """(url, metadata) extraction jobs of crawled pages with their site's topology."""
    return summaries.select(
        "url",
        F.struct("page_type", F.coalesce("js_required", F.lit(False)).alias("js_required"), F.col("parent_url"), "topology").alias("metadata"),
        F.when(F.coalesce("js_required", F.lit(False)), "playwright").otherwise("fetch").alias("engine"),
    )


def job_script(job_rows: DataFrame, path: str) -> str:
    """A script that fetches the jobs of one crawl, written to ``path``."""
    listed = [{"url": r["url"], "engine": r["engine"]} for r in job_rows.select("url", "engine").collect()]
    text = f"JOBS = {json.dumps(listed, indent=1)}\n\n\ndef main(fetch):\n    for job in JOBS:\n        fetch(job['url'], engine=job['engine'])\n"
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def html_report(pages: DataFrame, path: str, stats: dict | None = None) -> str:
    """A page with the chart; without ``stats`` the savings are a nominal 40 % of the pages."""
    chart = mermaid(pages)
    n = pages.count()
    stats = stats or {"total": n, "saved": int(n * 0.4), "efficiency": "40%"}
    rows = "".join(f"<li>{html.escape(str(k))}: {html.escape(str(v))}</li>" for k, v in stats.items())
    text = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Site topology</title></head><body><ul>{rows}</ul><pre class="mermaid">{html.escape(chart)}</pre></body></html>'
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path
