"""HTML functions: anchors with their context, framework and login markers, text.

The built-in path is a fold over tag tokens inside the JVM.  Pages that a
tokeniser cannot read as a parser would (``>`` inside attribute values,
unclosed anchors) go through ``exact_anchors``, an Arrow function over the
standard library's parser.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules
from .urls import any_of

_COMMENTS = r"(?s)<!--.*?-->"
_SCRIPTS = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_TOKENS = r"(?is)</?(?:a|nav|header|footer)\b[^>]*>|[^<]+|<[^>]*>"
_HREF = r"""(?is)^<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]

ANCHOR = "struct<href:string,text:string,in_nav:boolean,in_header_footer:boolean>"


def unescaped(text: Column) -> Column:
    for entity, char in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def without_scripts(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), _COMMENTS, ""), _SCRIPTS, "")


def anchors(html: Column, rendered: bool = False) -> Column:
    """Anchors with href in page order, as an array of ``ANCHOR``.

    In ``rendered`` mode elements with a banner or contentinfo role count as
    header or footer, as they do in a browser's document.
    """
    tokens = F.regexp_extract_all(without_scripts(html), F.lit(_TOKENS), F.lit(0))
    start = F.struct(
        F.lit(0).alias("nav"),
        F.lit(0).alias("hf"),
        F.lit(None).cast(ANCHOR).alias("open"),
        F.array().cast(f"array<{ANCHOR}>").alias("found"),
    )

    def step(acc: Column, token: Column) -> Column:
        is_tag = token.startswith("<")
        opens = lambda tag: token.rlike(rf"(?i)^<{tag}\b")
        closes = lambda tag: token.rlike(rf"(?i)^</{tag}\b")
        head = opens("(?:header|footer)")
        if rendered:
            head = head | token.rlike(r"(?i)^<(?:header|footer|[a-z]+\b[^>]*role\s*=\s*[\"']?(?:banner|contentinfo))\b")
        nav = acc["nav"] + F.when(opens("nav"), 1).when(closes("nav"), -1).otherwise(0)
        hf = acc["hf"] + F.when(head, 1).when(closes("(?:header|footer)"), -1).otherwise(0)
        link = token.rlike(_HREF)
        href = F.concat(F.regexp_extract(token, _HREF, 1), F.regexp_extract(token, _HREF, 2), F.regexp_extract(token, _HREF, 3))
        fresh = F.struct(unescaped(href).alias("href"), F.lit("").alias("text"), (nav > 0).alias("in_nav"), (hf > 0).alias("in_header_footer"))
        longer = F.struct(
            acc["open"]["href"].alias("href"),
            F.concat(acc["open"]["text"], token).alias("text"),
            acc["open"]["in_nav"].alias("in_nav"),
            acc["open"]["in_header_footer"].alias("in_header_footer"),
        )
        ends = acc["open"].isNotNull() & (closes("a") | opens("a"))
        return F.struct(
            nav.alias("nav"),
            hf.alias("hf"),
            F.when(link, fresh).when(ends, F.lit(None).cast(ANCHOR)).when(acc["open"].isNotNull() & ~is_tag, longer).otherwise(acc["open"]).alias("open"),
            F.when(ends, F.concat(acc["found"], F.array(acc["open"]))).otherwise(acc["found"]).alias("found"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["open"].isNotNull(), F.concat(acc["found"], F.array(acc["open"]))).otherwise(acc["found"])

    found = F.aggregate(tokens, start, step, finish)
    return F.transform(
        found,
        lambda a: F.struct(
            a["href"].alias("href"), collapsed(unescaped(a["text"])).alias("text"), a["in_nav"].alias("in_nav"), a["in_header_footer"].alias("in_header_footer")
        ),
    )


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.nav, self.hf, self.open = [], 0, 0, None

    def handle_starttag(self, tag, attrs):
        if tag == "nav":
            self.nav += 1
        elif tag in ("header", "footer"):
            self.hf += 1
        elif tag == "a":
            self.close_anchor()
            href = dict(attrs).get("href")
            if href is not None:
                self.open = [href, [], self.nav > 0, self.hf > 0]

    def handle_endtag(self, tag):
        if tag == "nav":
            self.nav = max(0, self.nav - 1)
        elif tag in ("header", "footer"):
            self.hf = max(0, self.hf - 1)
        elif tag == "a":
            self.close_anchor()

    def handle_data(self, data):
        if self.open:
            self.open[1].append(data)

    def close_anchor(self):
        if self.open:
            href, text, nav, hf = self.open
            self.found.append({"href": href, "text": " ".join("".join(text).split()), "in_nav": nav, "in_header_footer": hf})
            self.open = None


def parsed_anchors(html: str | None) -> list[dict]:
    parser = _Anchors()
    parser.feed(html or "")
    parser.close()
    parser.close_anchor()
    return parser.found


def exact_anchors(pages: DataFrame) -> DataFrame:
    """page_id and anchors by the standard library's parser, in Arrow batches."""
    kind = pa.list_(pa.struct([("href", pa.string()), ("text", pa.string()), ("in_nav", pa.bool_()), ("in_header_footer", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parsed_anchors(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(found, kind)], ["page_id", "anchors"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, f"page_id long, anchors array<{ANCHOR}>")


def hrefs(html: Column) -> Column:
    """Values of all anchors' href, in page order."""
    return F.transform(anchors(html), lambda a: a["href"])


def spa_framework(html: Column) -> Column:
    """next, vue, react, angular, hybrid or null, by markers in the page."""
    h = F.lower(F.coalesce(html, F.lit("")))
    has_id = lambda *ids: h.rlike(r"<[a-z][^>]*\sid\s*=\s*[\"']?(?:" + "|".join(ids) + r")[\"'\s>]")
    hits = F.array_distinct(
        F.filter(
            F.array(
                F.when(has_id("__next") | h.contains("__next_data__"), "next"),
                F.when(has_id("__nuxt") | h.contains("window.__nuxt__"), "vue"),
                F.when(has_id("root", "__next") | h.contains("data-reactroot"), "react"),
                F.when(h.contains("data-v-app"), "vue"),
                F.when(h.rlike(r"<app-root\b|\sng-version\s*="), "angular"),
            ),
            lambda x: x.isNotNull(),
        )
    )
    return F.when(F.size(hits) > 1, "hybrid").otherwise(F.try_element_at(hits, F.lit(1)))


def plain_text(html: Column) -> Column:
    return collapsed(unescaped(F.regexp_replace(without_scripts(html), "<[^>]*>", " ")))


def login_wall(html: Column, url: Column) -> Column:
    """Why a page seems to need a login, else none."""
    h = F.lower(F.coalesce(html, F.lit("")))
    main = h.rlike(r"<(?:main|article)\b|\srole\s*=\s*[\"']?main\b")
    text = F.lower(plain_text(html))
    return (
        F.when(any_of(F.lower(F.coalesce(url, F.lit(""))), rules.LOGIN_URL_TOKENS), "url_login_redirect")
        .when(h.rlike(r"<input\b[^>]*\stype\s*=\s*[\"']?password\b"), "password_field_present")
        .when(h.rlike(r"<form\b[^>]*\saction\s*=\s*[\"']?[^\"'>]*(?:login|signin|auth|sso)"), "login_form_present")
        .when(h.rlike(r"<meta\b[^>]*name\s*=\s*[\"']?robots\b[^>]*noindex") & ~main, "robots_noindex_without_main")
        .when(any_of(text, ["sign in", "log in", "create account", "continue with", "join now"]) & ~main, "auth_prompt_without_main")
        .otherwise("none")
    )


def content(html: Column) -> Column:
    """Readable text of a page: furniture and tags removed, blocks on lines of their own.

    Not the output of any particular extractor; the structure of the text is
    kept, its markup is not.
    """
    h = F.regexp_replace(without_scripts(html), r"(?is)<head\b.*?</head\s*>|<nav\b.*?</nav\s*>|<footer\b.*?</footer\s*>|<aside\b.*?</aside\s*>|<form\b.*?</form\s*>", " ")
    h = F.regexp_replace(h, r"[\s ]+", " ")
    h = F.regexp_replace(h, r"(?i)</?(?:p|div|section|article|main|h[1-6]|ul|ol|li|table|tr|blockquote|pre)\b[^>]*>", "\n")
    h = unescaped(F.regexp_replace(h, "<[^>]*>", " "))
    lines = F.filter(F.transform(F.split(h, "\n"), collapsed), lambda x: x != "")
    return F.array_join(lines, "\n")


def state_hash(html: Column) -> Column:
    return F.substring(F.sha2(html, 256), 1, 16)
