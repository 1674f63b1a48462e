"""Main text of web pages by consensus of each host's pages.

Every page nominates the path of its best container: tags and generalised
classes from the body down, ending where no single child holds all of the
article.  Text that most pages of the host share is no sign of an article and
has no weight in this, but it is never dropped for that.  Spark sums the
nominations per host, and each page is extracted again from the host's winning
path that it has; a page with none of them uses its own.  Menus, notices and
other furniture are left out by tag, role and class, and nothing else is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import small_batches, written

#: Share of a host's nominations from which a path wins; pages that have no winning path use their own.
LEAST_VOTES = 0.01
#: Share of a host's pages from which a text is common, and the least pages that show one.
COMMON, LEAST_PAGES = 0.5, 4
#: Share of the text that a child must hold on a page without any text of its own.
MOST = 0.7

_FURNITURE_TAGS = frozenset(
    "head script style noscript template svg nav header footer aside form button select textarea iframe object dialog menu".split()
)
_FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Class names and ids of furniture as a whole, and with each other or with words for boxes.
_FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription sidebar aside widget widgets related recommended "
    "recommendations share sharing social comment comments commentlist disqus respond replies reply menu nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager header masthead footer form login signup search".split()
)
_BOX_WORDS = frozenset(
    "box list item items wrapper wrap container content slot block area section button buttons btn bar inner outer site page top bottom left right "
    "unit link links panel group row col column n main primary secondary global the by of and user users reader readers thread posts".split()
)
#: Parts of a name that say enough whatever else is in it.
_SURE_WORDS = frozenset("comments commentlist disqus adsense advert adverts advertisement advertising newsletter navbar breadcrumb breadcrumbs sidebar".split())
_MAIN_TAGS = frozenset("html body article main".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_CONTAINERS = frozenset("html body main article section div td center".split())
_SPACES = frozenset(["br", "td", "th", "wbr", "option"])
#: A start tag that ends an open element of these, up to the element's list or table.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>script|style|textarea|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*|/)?)>"
    r"|</?[a-zA-Z][^>]*>|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: Dropped elements whose end is often lacking: without one they hold nothing.
_OFTEN_OPEN = frozenset("noscript template svg iframe object".split())
#: Text elements, which only a whole name makes furniture.
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())


class _Node:
    __slots__ = ("tag", "path", "parent", "dropped", "main", "link")

    def __init__(self, tag, path, parent, dropped, main, link):
        self.tag, self.path, self.parent, self.dropped, self.main, self.link = tag, path, parent, dropped, main, link


def _is_furniture(name: str, whole: bool) -> bool:
    """Whether a class name or id is one of furniture."""
    if name.lower() in _FURNITURE_WORDS:
        return True
    words = {w.lower() if not w.isdigit() else "n" for w in _NAME_PART.findall(name)}
    if whole or not words & _FURNITURE_WORDS:
        return False
    return bool(words & _SURE_WORDS) or words <= _FURNITURE_WORDS | _BOX_WORDS


def _opened(tag: str, attrs: str, parent: _Node) -> _Node:
    name, dropped, main = tag, parent.dropped or tag in _FURNITURE_TAGS, tag in ("article", "main")
    if attrs and not attrs.isspace():
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attrs)}
        role = found.get("role", "").lower()
        main = main or role == "main" or found.get("itemprop") == "articleBody"
        classes = found.get("class", "").split()
        if classes:
            name += "." + ".".join(sorted({re.sub(r"\d+", "N", c) for c in classes}))
        if not dropped and tag not in _MAIN_TAGS:
            dropped = any(_is_furniture(c, tag in _TEXT_TAGS) for c in [*classes, found.get("id", "")])
        dropped = dropped or role in _FURNITURE_ROLES
    path = f"{parent.path}>{name}" if tag in _CONTAINERS else parent.path
    return _Node(tag, path, parent, dropped, main, parent.link or tag == "a")


@lru_cache(maxsize=None)
def _ends_or_begins(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){tag}\b", re.IGNORECASE)


def _is_closed(page: str, tag: str, at: int) -> bool:
    """Whether an element that begins before ``at`` has an end tag; of those that cannot nest, before the next begins."""
    depth = 1
    for m in _ends_or_begins(tag).finditer(page, at):
        if m[1]:
            depth -= 1
        elif tag in ("noscript", "iframe"):
            return False
        else:
            depth += 1
        if not depth:
            return True
    return False


def blocks(page: str) -> list[tuple[_Node, str, int]]:
    """(node, text, letters inside links) of each block that isn't furniture, in page order."""
    root = _Node("", "", None, False, False, False)
    stack = [root]
    out: list[tuple[_Node, str, int]] = []
    parts: list[str] = []
    linked = 0
    owner = root

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((owner, text, linked))
            parts.clear()
        linked = 0

    def close(tags: tuple, until: tuple) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in until:
                return

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not stack[-1].dropped:
            text = html.unescape(page[at : m.start()])
            if not parts:
                owner = stack[-1]
            parts.append(text)
            if stack[-1].link:
                linked += len(text)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag in _BLOCKS or tag in _CONTAINERS:
                        flush()
                    del stack[i:]
                    break
                if tag not in _BLOCKS and stack[i].tag in _CONTAINERS:
                    break
            continue
        if tag in _BLOCKS:
            flush()
            close(("p",), tuple(_CONTAINERS))
        if tag in _SPACES and parts:
            parts.append(" ")
        if tag in _ENDS:
            close(*_ENDS[tag])
        if tag in _OFTEN_OPEN and not _is_closed(page, tag, at):
            continue
        if tag not in _VOID and not (m["attrs"] or "").endswith("/"):
            stack.append(_opened(tag, m["attrs"] or "", stack[-1]))
    if at < len(page) and not stack[-1].dropped:
        if not parts:
            owner = stack[-1]
        parts.append(html.unescape(page[at:]))
    flush()
    return out


def _chain(node: _Node) -> list[_Node]:
    """Container nodes from the outermost to the one around ``node``."""
    chain = []
    while node is not None:
        if node.tag in _CONTAINERS:
            chain.append(node)
        node = node.parent
    return chain[::-1]


def _hashed(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


def best_path(found: list[tuple[_Node, str, int]], common: frozenset[int] = frozenset()) -> str:
    """Path of the page's best container; ``common`` has hashes of texts without weight.

    It goes down while one child holds all the running text that has weight, or
    is the only article or main element beside others.
    """
    everything = [(_chain(node), max(0, len(text) - linked), text) for node, text, linked in found]
    weights = [(c, w) for c, w, text in everything if w and not (common and _hashed(text) in common)]
    most_of = 1.0
    if not weights:
        # a copy of the host's other pages says little: the child with most of the text stands for it
        weights, most_of = [(c, w) for c, w, _ in everything if w], MOST if common else 1.0
    total = sum(w for _, w in weights)
    path, depth = "", 0
    while weights:
        held: dict[int, list] = {}
        for chain, w in weights:
            entry = held.setdefault(id(chain[depth]) if len(chain) > depth else 0, [0, chain[depth] if len(chain) > depth else None])
            entry[0] += w
        most, node = max(held.values(), key=lambda e: e[0] if e[1] is not None else -1)
        mains = [e[1] for e in held.values() if e[1] is not None and e[1].main]
        if len(mains) == 1:
            return mains[0].path
        if node is None or most < most_of * total:
            return path
        path, depth = node.path, depth + 1
        weights = [(c, w) for c, w in weights if len(c) >= depth and c[depth - 1] is node]
    return path


def text_of(page: str | None, paths: list[str], common: frozenset[int] = frozenset()) -> str:
    """Text in the first of ``paths`` that the page has, else in its own best container."""
    found = blocks(page or "")
    chains = [{n.path for n in _chain(node)} for node, _, _ in found]
    for path in [*paths, best_path(found, common)]:
        inside = [text for (_, text, _), chain in zip(found, chains, strict=True) if path in chain]
        if inside:
            return "\n\n".join(inside)
    return "\n\n".join(text for _, text, _ in found)


def _host(url) -> object:
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def common_texts(pages: DataFrame) -> DataFrame:
    """Host and the hashes of block texts on COMMON of its pages: at most blocks of a page / COMMON of them.

    Counts are combined before the shuffle, so a host with a third of all
    pages is not gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[0, *{_hashed(text) for _, text, _ in blocks(x.as_py() or "")}] for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.list_(pa.int64()))], ["host", "texts"])

    texts = pages.mapInArrow(run, "host string, texts array<long>").select("host", F.explode("texts").alias("text"))
    counts = texts.groupBy("host", "text").agg(F.count(F.lit(1)).alias("n"))
    # the text 0 is on every page, the largest count is the number of pages
    counts = written(counts.where(F.col("n") >= LEAST_PAGES * COMMON))
    totals = counts.where((F.col("text") == 0) & (F.col("n") >= LEAST_PAGES)).select("host", F.col("n").alias("pages"))
    often = counts.where("text <> 0").join(totals, "host").where(F.col("n") >= COMMON * F.col("pages"))
    return often.groupBy("host").agg(F.array_sort(F.collect_list("text")).alias("common"))


def winners(pages: DataFrame) -> DataFrame:
    """Host and its winning paths, most votes first; ``pages`` has host, html and common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [best_path(blocks(x.as_py() or ""), frozenset(c.as_py() or ())) for x, c in zip(batch.column("html"), batch.column("common"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(best, pa.string())], ["host", "path"])

    summed = pages.mapInArrow(run, "host string, path string").where("path <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))
    totals = summed.groupBy("host").agg(F.sum("votes").alias("total"))
    # at most 1 / LEAST_VOTES paths of a host
    top = summed.join(totals, "host").where(F.col("votes") >= LEAST_VOTES * F.col("total"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("votes"), "path")))
    return top.groupBy("host").agg(F.transform(ordered, lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """Main text of each row of ``pages``: page_id, url, text, n_chars.

    Edge cases: null or empty html has the text ''.  A null url has the empty
    host, whose pages vote together.  White space is what Python's
    ``str.split`` splits at, so a no-break space is one.  Unclosed tags end with
    their parent; an unclosed comment, script or style runs to the end, an
    unclosed noscript, template, svg, iframe or object holds nothing.  Hidden
    elements are text like any other.  Repeated rows are all extracted.  An
    empty table gives no rows.  Columns other than page_id, url and html are
    ignored, whatever their names.

    Spark broadcasts the tables of hosts if they are below its size threshold
    and else joins by host.
    """
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    by_host = rows.withColumn("host", _host(F.col("url")))
    known = by_host.join(written(common_texts(by_host.select("host", "html"))), "host", "left")
    voted = written(winners(known.select("host", "html", "common")))
    joined = known.join(voted, "host", "left").select("page_id", "url", "html", "paths", "common")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c) for c in ("html", "paths", "common"))
            texts = [text_of(h.as_py(), p.as_py() or [], frozenset(c.as_py() or ())) for h, p, c in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
