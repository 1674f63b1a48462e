"""Discovery: merged sources, priorities, critical coverage, breadth-first levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, urls
from ..sources.scratch import written


def merge_sources(found: DataFrame) -> DataFrame:
    """One row for each canonical URL of ``found`` (url, source, depth, priority).

    Only sitemap rows keep a priority of their own.  Union and one group-by in
    place of full outer joins of the sources.
    """
    own = F.when(F.col("source") == "sitemap", F.coalesce("priority", F.lit(rules.DEFAULT_PRIORITY))).otherwise(rules.DEFAULT_PRIORITY)
    rows = found.select(urls.normalize(F.col("url")).alias("url"), "source", "depth", own.alias("priority"))
    merged = rows.groupBy("url").agg(
        F.array_sort(F.collect_set("source")).alias("sources"), F.min("depth").alias("depth"), F.max("priority").alias("base_priority")
    )
    return merged.withColumns({"page_type": urls.critical_type(F.col("url")), "site": urls.origin(F.col("url"))})


def prioritized(merged: DataFrame) -> DataFrame:
    """Adds the score: priority, path, agreement of sitemap and links, shallowness."""
    both = F.array_contains("sources", "sitemap") & F.array_contains("sources", "discovery")
    score = (
        F.col("base_priority")
        + urls.priority_boost(F.col("url"))
        + F.when(both, rules.AGREEMENT_BOOST).otherwise(0.0)
        + F.when(F.col("depth") <= rules.SHALLOW_DEPTH, rules.SHALLOW_BOOST).otherwise(0.0)
    )
    return merged.withColumn("priority_score", F.round(score, 9))


def covered(items: DataFrame, cap: int) -> DataFrame:
    """The best ``cap`` items of each site, with its critical types represented.

    The best item of a type that is missing replaces the lowest item that is
    not the first of a critical type, missing types in alphabetical order, as
    long as there is one to replace.  Expressed with ranks: no loop, no site
    gathered beyond its cap.
    """
    # read several times below; written so that the URL expressions are computed, and planned, once
    items = written(items)
    order = [F.desc("priority_score"), F.asc("depth"), F.asc("url")]
    salted = Window.partitionBy("site", F.pmod(F.xxhash64("url"), F.lit(32))).orderBy(*order)
    key = F.struct((-F.col("priority_score")).alias("s"), "depth", "url")
    firsts = items.where("page_type is not null").groupBy("site", "page_type").agg(F.min(key).alias("f")).select("site", "page_type", F.col("f.url").alias("url"))
    top = items.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= cap).drop("n")
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(*order))).where(F.col("rank") <= cap)
    held = top.join(firsts.select("site", "url", F.lit(True).alias("first")), ["site", "url"], "left").withColumn("first", F.coalesce("first", F.lit(False)))
    missing = firsts.join(held.where("first").select("site", "page_type"), ["site", "page_type"], "left_anti")
    room = held.groupBy("site").agg(F.count_if(~F.col("first")).alias("removable"))
    missing = (
        missing.withColumn("turn", F.row_number().over(Window.partitionBy("site").orderBy("page_type")))
        .join(held.groupBy("site").agg(F.count(F.lit(1)).alias("size")), "site")
        .join(room, "site")
        # below the cap a type is added without a loss
        .where(F.col("turn") <= F.col("removable") + F.greatest(F.lit(0), cap - F.col("size")))
    )
    losses = missing.groupBy("site").agg(F.greatest(F.lit(0), F.count(F.lit(1)) - F.first(F.greatest(F.lit(0), cap - F.col("size")))).alias("losses"))
    low = F.row_number().over(Window.partitionBy("site", "first").orderBy(F.desc("rank")))
    kept = held.withColumn("low", F.when(~F.col("first"), low)).join(losses, "site", "left")
    kept = kept.where(F.col("low").isNull() | (F.col("low") > F.coalesce("losses", F.lit(0)))).select(*items.columns)
    added = items.join(missing.select("site", "url"), ["site", "url"]).select(*items.columns)
    both = kept.unionByName(added)
    return both.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy(*order)))


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """Breadth-first levels: (site, url, depth, parent, place).

    ``edges`` has site, src and dst, ``seeds`` site and url.  A level is one
    join and one anti-join for all sites; places follow the queue: parents in
    order, each one's children by URL.  With ``max_pages`` a site ends when
    it has as many.
    """
    level = written(seeds.select("site", "url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("place")).distinct())
    found = level
    for depth in range(1, max_depth + 1):
        steps = level.select("site", F.col("url").alias("src"), F.col("place").alias("turn")).join(edges.select("site", "src", "dst"), ["site", "src"])
        first = steps.groupBy("site", F.col("dst").alias("url")).agg(F.min(F.struct("turn", "src")).alias("via"))
        fresh = first.join(found.select("site", "url"), ["site", "url"], "left_anti")
        before = found.groupBy("site").agg(F.count(F.lit(1)).alias("before"))
        queue = [F.col("via.turn"), F.col("url")]
        if max_pages is not None:
            salted = Window.partitionBy("site", F.pmod(F.xxhash64("url"), F.lit(32))).orderBy(*queue)
            fresh = fresh.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= max_pages).drop("n")
        placed = fresh.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy(*queue))).join(before, "site")
        placed = placed.withColumn("place", (F.col("n") + F.col("before")).cast("int"))
        if max_pages is not None:
            placed = placed.where(F.col("place") <= max_pages)
        level = written(placed.select("site", "url", F.lit(depth).alias("depth"), F.col("via.src").alias("parent"), "place"))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def state_links(states: DataFrame, cap: int = 50) -> DataFrame:
    """Links found by the first state that shows them: (site, url, state_label, dom_hash, state_seq).

    ``states`` has site, seed_url, state_seq, state_label, html and links, the
    hrefs of the state.  A document seen before adds nothing.
    """
    from ..functions import html

    hashed = states.withColumn("dom_hash", html.state_hash(F.col("html")))
    first = hashed.groupBy("site", "dom_hash").agg(F.min("state_seq").alias("state_seq"))
    fresh = hashed.join(first, ["site", "dom_hash", "state_seq"])
    rows = fresh.select("site", "seed_url", "state_seq", "state_label", "dom_hash", F.posexplode("links").alias("pos", "href"))
    # each URL step is written: filters pushed into the next would repeat its expressions many times over
    rows = written(rows.where(~urls.should_skip_href(F.col("href"))).withColumn("absolute", urls.resolve(F.col("seed_url"), F.col("href"))).drop("href"))
    rows = written(rows.withColumn("url", urls.normalize(F.col("absolute"))).drop("absolute"))
    rows = rows.where(
        ~urls.should_skip_href(F.col("url")) & (urls.origin(F.col("url")) == urls.origin(F.col("seed_url"))) & ~urls.has_binary_extension(F.col("url"))
    )
    best = rows.groupBy("site", "url").agg(F.min(F.struct("state_seq", "pos", "state_label", "dom_hash")).alias("b"))
    order = Window.partitionBy("site").orderBy("b.state_seq", "b.pos")
    kept = best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap)
    return kept.select("site", "url", "b.state_label", "b.dom_hash", "b.state_seq")


def exploration_quality(states: DataFrame, links: DataFrame, budget: int = 5, early: int = 2) -> DataFrame:
    """Actions taken, states with new links and whether exploring stopped early, by site.

    The first state is the page as loaded, each later one an interaction.
    Exploring ends at the budget, or at the ``early``-th interaction if no state
    so far had a new link.
    """
    added = links.groupBy("site", "state_seq").agg(F.count(F.lit(1)).alias("added"))
    rows = states.select("site", "state_seq").join(added, ["site", "state_seq"], "left").withColumn("added", F.coalesce("added", F.lit(0)))
    rows = rows.where(F.col("state_seq") <= budget + 1)
    so_far = F.sum("added").over(Window.partitionBy("site").orderBy("state_seq"))
    rows = rows.withColumn("stop", F.when((F.col("state_seq") - 1 >= early) & (so_far == 0), F.col("state_seq")))
    rows = rows.withColumn("end", F.coalesce(F.min("stop").over(Window.partitionBy("site")), F.lit(budget + 1))).where("state_seq <= end")
    sums = rows.groupBy("site").agg((F.count(F.lit(1)) - 1).alias("actions_taken"), F.count_if(F.col("added") > 0).alias("new_states"))
    return sums.select(
        "site",
        "actions_taken",
        "new_states",
        F.round(urls.safe_ratio(F.col("new_states"), F.col("actions_taken")), 2).alias("dom_change_ratio"),
        ((F.col("actions_taken") >= early) & (F.col("new_states") == 0)).alias("early_stopped"),
    )


#: Kinds of elements worth an interaction: fitting tokens of text, of aria-label, and other conditions.
CANDIDATES = ("menu", "nav_hover", "load_more", "route_change", "modal")


def candidates(elements: DataFrame, limit: int = 10) -> DataFrame:
    """(page, kind, seq) of elements to interact with.

    ``elements`` has page, seq, tag, role, text, href, in_nav, in_header and
    aria_label, aria_haspopup, aria_controls.  Of each kind's elements the
    first ``limit`` of a page are looked at, and then filtered.
    """
    from ..functions.urls import any_of

    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    tag, text, aria = low("tag"), low("text"), low("aria_label")
    clickable = tag.isin("button", "a")
    kinds = {
        "menu": ((tag == "button") | (low("role") == "button") | F.col("aria_label").isNotNull(), any_of(aria, ["menu", "nav", "navigation"]) | any_of(text, ["menu", "navigation"])),
        "nav_hover": (clickable & (F.col("in_nav") | F.col("in_header")), F.lit(True)),
        "load_more": (clickable, any_of(text, ["load more", "show more", "next", "more"])),
        "route_change": ((tag == "a") & F.col("href").isNotNull(), F.lit(True)),
        "modal": (
            (low("aria_haspopup") == "dialog") | F.col("aria_controls").isNotNull() | clickable,
            (low("aria_haspopup") == "dialog") | (F.trim(F.coalesce("aria_controls", F.lit(""))) != "") | any_of(text, ["modal", "popup", "dialog", "overlay"]),
        ),
    }
    out = None
    for kind, (pool, fits) in kinds.items():
        n = F.row_number().over(Window.partitionBy("page").orderBy("seq"))
        part = elements.where(pool).withColumn("n", n).where(F.col("n") <= limit).where(fits).select("page", F.lit(kind).alias("kind"), "seq")
        out = part if out is None else out.unionByName(part)
    return out
