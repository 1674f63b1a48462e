"""URL filters: listed rules first, then a tree of path templates per host.

The tree generalises the variable segments of a host's paths into wildcards,
level by level.  Sibling templates whose labelled rates do not differ by more
than chance are merged, and a template is rejected if its smoothed share of
bad labels is high.  All steps are DataFrame functions over counts of
(host, path shape), so no page is looked at alone and a host with a third of
all pages is summed before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import written

#: (verdict, host and path); a rule also fits subdomains and longer paths.
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
#: Levels of the tree that take names by pages; segments below them are one
#: wildcard tail but for branches that labels set apart.
LEVELS = 4
#: A node with this many children or more names only those with this percentage of its pages
#: and those that labels set apart.
MANY, LEAST_PERCENT = 8, 5
#: Deviations within which sibling templates count as alike.
ALIKE = 1.96
#: Weight of the prior in labelled pages; bad share from which a template is rejected.
PRIOR_WEIGHT, REJECT = 5.0, 0.5
#: Segments that are variable by their form: numbers, hexadecimal digests, UUIDs.
VARIABLE = r"^(?:[0-9]+|[0-9a-f]{16,}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})(?:\.[A-Za-z0-9]{1,5})?$"

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ://, A-Z lower-cased; empty if there is none."""
    host = F.coalesce(F.regexp_extract(url, _URL, 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _ruled(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, _, path = text.partition("/")
        own = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
        fits = own & F.startswith(F.col("path"), F.lit("/" + path))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _shape(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(VARIABLE), "*").otherwise(s))


def _apart(own_n: str, own_bad: str, all_n: str, all_bad: str) -> Column:
    """Whether a branch's bad share, smoothed towards that of all, differs from it by more than chance."""
    pooled = F.try_divide(all_bad, all_n)
    rate = (F.col(own_bad) + PRIOR_WEIGHT * pooled) / (F.col(own_n) + PRIOR_WEIGHT)
    spread = F.sqrt(pooled * (1 - pooled) / (F.col(own_n) + PRIOR_WEIGHT))
    return F.coalesce(F.abs(rate - pooled) > ALIKE * spread, F.lit(False))


def _templates(shapes: DataFrame) -> DataFrame:
    """Template of each (host, shape); ``shapes`` has its pages in n, and their labels."""
    sums = [F.sum(c).alias(c) for c in ("n_labelled", "n_bad")]
    node_sums = [F.sum(c).alias(f"all_{c}") for c in ("n_labelled", "n_bad")]
    apart = _apart("n_labelled", "n_bad", "all_n_labelled", "all_n_bad")
    tree = shapes.select("host", "shape", "n", "n_labelled", "n_bad").withColumn("prefix", F.lit(""))
    for level in range(1, LEVELS + 1):
        segment = F.when(F.size("shape") >= level, F.element_at("shape", F.least(F.size("shape"), F.lit(level))))
        here = tree.withColumn("segment", segment)
        children = here.where("segment is not null").groupBy("host", "prefix", "segment").agg(F.sum("n").alias("pages"), *sums)
        nodes = children.groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("branches"), F.sum("pages").alias("all_pages"), *node_sums)
        named = (
            children.join(nodes, ["host", "prefix"])
            .where((F.col("branches") < MANY) | (100 * F.col("pages") >= LEAST_PERCENT * F.col("all_pages")) | apart)
            .select("host", "prefix", "segment", F.lit(True).alias("named"))
        )
        tree = (
            here.join(named, ["host", "prefix", "segment"], "left")
            .withColumn(
                "prefix",
                F.when(F.col("segment").isNull(), F.col("prefix")).otherwise(
                    F.concat("prefix", F.lit("/"), F.when(F.col("named"), F.col("segment")).otherwise("*"))
                ),
            )
            .select("host", "shape", "n", "n_labelled", "n_bad", "prefix")
        )
    return _tails(tree)


def _tails(tree: DataFrame) -> DataFrame:
    """Templates below LEVELS: tails, but for the branches that labels set apart."""
    last = tree.agg(F.max(F.size("shape"))).first()[0] or 0
    if last <= LEVELS:
        return tree.select("host", "shape", F.col("prefix").alias("template"))
    # rest: the wildcards since the last name; mixed: whether the node has good and bad pages, else nothing below differs
    tree = written(tree.withColumns({"rest": F.lit(""), "mixed": F.lit(True)}))
    sums = [F.sum(c).alias(c) for c in ("n_labelled", "n_bad")]
    node_sums = [F.sum(c).alias(f"all_{c}") for c in ("n_labelled", "n_bad")]
    apart = _apart("n_labelled", "n_bad", "all_n_labelled", "all_n_bad")
    for level in range(LEVELS + 1, last + 1):
        inside = (F.size("shape") >= level) & F.col("mixed")
        here = tree.withColumn("segment", F.when(inside, F.element_at("shape", F.least(F.size("shape"), F.lit(level)))))
        children = here.where("segment is not null").groupBy("host", "prefix", "rest", "segment").agg(*sums)
        nodes = children.groupBy("host", "prefix", "rest").agg(*node_sums).where("all_n_bad > 0 and all_n_bad < all_n_labelled")
        known = children.join(nodes, ["host", "prefix", "rest"]).select("host", "prefix", "rest", "segment", apart.alias("named"))
        name = F.concat("prefix", "rest", F.lit("/"), "segment")
        tree = written(
            here.join(known, ["host", "prefix", "rest", "segment"], "left").select(
                "host",
                "shape",
                "n",
                "n_labelled",
                "n_bad",
                F.when(F.col("named"), name).otherwise(F.col("prefix")).alias("prefix"),
                F.when(F.col("named"), "").when(F.size("shape") >= level, F.concat("rest", F.lit("/*"))).otherwise(F.col("rest")).alias("rest"),
                F.col("named").isNotNull().alias("mixed"),
            )
        )
        if tree.where(F.col("mixed") & (F.size("shape") > level)).isEmpty():
            tree = tree.withColumn("rest", F.when(F.size("shape") > level, "/**").otherwise(F.col("rest")))
            break
    return tree.select("host", "shape", F.concat("prefix", F.when(F.col("rest") != "", "/**").otherwise("")).alias("template"))


def _judged(templates: DataFrame) -> DataFrame:
    """Smoothed bad share of each template(host, template, n_labelled, n_bad)."""
    total = templates.agg(F.sum("n_labelled").alias("n"), F.sum("n_bad").alias("bad")).first()
    prior = (total["bad"] or 0) / total["n"] if total["n"] else 0.0
    hosts = templates.groupBy("host").agg(F.sum("n_labelled").alias("h_n"), F.sum("n_bad").alias("h_bad"))
    # branches are siblings if their wildcards stand in the same places
    form = F.regexp_replace("template", r"/[^/*]+", "/x")
    rows = templates.withColumn("form", form)
    pools = rows.groupBy("host", "form").agg(F.sum("n_labelled").alias("p_n"), F.sum("n_bad").alias("p_bad"))
    rate, pooled = F.try_divide("n_bad", "n_labelled"), F.try_divide("p_bad", "p_n")
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), F.col("n_labelled")) + F.try_divide(F.lit(1), F.col("p_n"))))
    alike = F.coalesce(F.abs(rate - pooled) <= ALIKE * spread, F.lit(True))
    rows = rows.join(pools, ["host", "form"]).withColumn("branch", F.when(alike, "").otherwise(F.col("template")))
    merged = rows.groupBy("host", "form", "branch").agg(F.sum("n_labelled").alias("m_n"), F.sum("n_bad").alias("m_bad"))
    host_rate = (F.col("h_bad") + PRIOR_WEIGHT * prior) / (F.col("h_n") + PRIOR_WEIGHT)
    purity = (F.col("m_bad") + PRIOR_WEIGHT * host_rate) / (F.col("m_n") + PRIOR_WEIGHT)
    return (
        rows.join(merged, ["host", "form", "branch"])
        .join(hosts, "host")
        .select("host", "template", F.round(purity, 9).alias("bad_share"))
    )


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Verdict on each row of ``pages``, by a rule or else by its template.

    Args:
        pages: has page_id and url; other columns are ignored, whatever their names.
        labelled: page_id and bad (0 or 1) of pages with a label.
        rules: (verdict, host/path) pairs; ``RULES`` by default.

    Returns page_id, host, path, rule, verdict, template, bad_share, one row
    per input row.

    Edge cases: a null url, or one without ://, has an empty host, path and
    template, and is judged with its like.  Null labels and labels of other
    pages are ignored; of contradicting labels of a page the bad one counts.
    A null page_id has no label.  Repeated rows count as pages and get equal
    verdicts.  Without labels nothing is rejected by the method.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("shape", _shape(F.col("path")))
    marks = labelled.where("page_id is not null and bad in (0, 1)").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    shapes = written(
        rows.join(marks, "page_id", "left")
        .groupBy("host", "shape")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("bad").alias("n_labelled"),
            F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad"),
        )
    )
    named = written(_templates(shapes))
    templates = written(
        shapes.join(named, ["host", "shape"]).groupBy("host", "template").agg(F.sum("n_labelled").alias("n_labelled"), F.sum("n_bad").alias("n_bad"))
    )
    judged = written(named.join(_judged(templates), ["host", "template"]))
    rule, said = _ruled(RULES if rules is None else rules)
    return (
        rows.join(judged, ["host", "shape"], "left")
        .withColumn("rule", rule)
        .withColumn("verdict", F.coalesce(said, F.when(F.col("bad_share") >= REJECT, "block").otherwise("allow")))
        .select("page_id", "host", "path", "rule", "verdict", "template", "bad_share")
    )


def labels_by_document(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id and bad for pages whose path ends in the id of a labelled document.

    Bad are low quality and toxic documents.
    """
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    ends = pages.select("page_id", number.alias("n")).select("page_id", F.expr("try_cast(n as long)").alias("n_doc"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    known = labels.select(F.col("doc_id").cast("long").alias("n_doc"), bad.alias("bad"))
    return ends.join(known, "n_doc").select("page_id", "bad")


def oracle() -> str:
    """DuckDB SQL for the filter over pages with labels by document."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    pooled, weight = "(anb / nullif(anl, 0))", f"(nl + {PRIOR_WEIGHT}::DOUBLE)"
    apart = f"coalesce(abs((nb + {PRIOR_WEIGHT}::DOUBLE * {pooled}) / {weight} - {pooled}) > {ALIKE}::DOUBLE * sqrt({pooled} * (1 - {pooled}) / {weight}), FALSE)"
    levels = "".join(
        f"""
c{k} AS (SELECT host, prefix, shape[{k}] AS segment, sum(n) AS pages, sum(nl) AS nl, sum(nb) AS nb FROM p{k - 1} WHERE len(shape) >= {k} GROUP BY ALL),
m{k} AS (SELECT host, prefix, segment FROM c{k} JOIN (SELECT host, prefix, count(*) AS branches, sum(pages) AS whole, sum(nl) AS anl, sum(nb) AS anb FROM c{k} GROUP BY ALL) USING (host, prefix)
  WHERE branches < {MANY} OR 100 * pages >= {LEAST_PERCENT} * whole OR {apart}),
p{k} AS (SELECT p.host, shape, n, nl, nb, CASE WHEN len(shape) < {k} THEN p.prefix ELSE p.prefix || '/' || coalesce(m.segment, '*') END AS prefix
  FROM p{k - 1} p LEFT JOIN m{k} m ON m.host = p.host AND m.prefix = p.prefix AND m.segment = shape[{k}]),"""
        for k in range(1, LEVELS + 1)
    )
    fits = []
    for said, text in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        host, _, path = text.partition("/")
        fits.append((said, text, f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"))
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for _, t, c in fits) + " END"
    said = "CASE " + " ".join(f"WHEN {c} THEN '{s}'" for s, _, c in fits) + " END"
    return f"""
WITH r AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), '{upper}', '{lower}') AS host, coalesce(regexp_extract(url, '{_URL}', 2), '') AS path FROM pages),
s AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda y: CASE WHEN regexp_matches(y, '{VARIABLE}') THEN '*' ELSE y END) AS shape FROM r),
lab AS (SELECT page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM s JOIN labels ON doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:\\.[a-z]+)?/?$', 1) AS BIGINT) GROUP BY page_id),
t0 AS (SELECT host, shape, count(*) AS n, count(bad) AS nl, coalesce(sum(bad), 0) AS nb FROM s LEFT JOIN lab USING (page_id) GROUP BY host, shape),
p0 AS (SELECT host, shape, n, nl, nb, '' AS prefix FROM t0),{levels}
tpl AS (SELECT host, shape, prefix || CASE WHEN len(shape) > {LEVELS} THEN '/**' ELSE '' END AS template FROM p{LEVELS}),
tt AS (SELECT host, template, regexp_replace(template, '/[^/*]+', '/x', 'g') AS form, sum(nl) AS nl, sum(nb) AS nb FROM t0 JOIN tpl USING (host, shape) GROUP BY ALL),
pr AS (SELECT coalesce(sum(nb) / nullif(sum(nl), 0), 0) AS prior FROM tt),
hs AS (SELECT host, sum(nl) AS hn, sum(nb) AS hb FROM tt GROUP BY host),
ps AS (SELECT host, form, sum(nl) AS pn, sum(nb) AS pb FROM tt GROUP BY ALL),
br AS (SELECT tt.*, CASE WHEN coalesce(abs(nb / nullif(nl, 0) - pb / nullif(pn, 0)) <= {ALIKE}::DOUBLE * sqrt(pb / nullif(pn, 0) * (1 - pb / nullif(pn, 0)) * (1 / nullif(nl, 0) + 1 / nullif(pn, 0))), TRUE) THEN '' ELSE template END AS branch FROM tt JOIN ps USING (host, form)),
mg AS (SELECT host, form, branch, sum(nl) AS mn, sum(nb) AS mb FROM br GROUP BY ALL),
j AS (SELECT br.host, br.template, round((mb + {PRIOR_WEIGHT}::DOUBLE * ((hb + {PRIOR_WEIGHT}::DOUBLE * prior) / (hn + {PRIOR_WEIGHT}::DOUBLE))) / (mn + {PRIOR_WEIGHT}::DOUBLE), 9) AS bad_share
  FROM br JOIN mg USING (host, form, branch) JOIN hs ON hs.host = br.host, pr)
SELECT page_id, s.host, path, rule, coalesce(said, CASE WHEN bad_share >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template, bad_share
FROM (SELECT *, {rule} AS rule, {said} AS said FROM s) s JOIN tpl USING (host, shape) JOIN j USING (host, template)
"""
