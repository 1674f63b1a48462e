"""DuckDB expressions that the oracles are put together from."""

from __future__ import annotations

import re

from ..functions import rules

RFC = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def any_of(x: str, tokens: list[str]) -> str:
    return f"regexp_matches({x}, {text('|'.join(re.escape(t) for t in tokens))})"


def part(u: str, n: int) -> str:
    return f"coalesce(regexp_extract({u}, '{RFC}', {n}), '')"


def scheme(u: str) -> str:
    return f"lower({part(u, 1)})"


def authority(u: str) -> str:
    return part(u, 2)


def path(u: str) -> str:
    return f"regexp_replace({part(u, 3)}, ';[^/]*$', '')"


def query(u: str) -> str:
    return part(u, 4)


def _host_port(u: str) -> str:
    return f"regexp_replace({authority(u)}, '^.*@', '')"


def host(u: str) -> str:
    return f"lower(regexp_extract({_host_port(u)}, '^([^:]*)', 1))"


def netloc(u: str) -> str:
    port = rf"regexp_extract({_host_port(u)}, ':([0-9]{{1,5}})$', 1)"
    return f"CASE WHEN {host(u)} = '' THEN lower({authority(u)}) WHEN {port} = '' OR ({scheme(u)} = 'http' AND {port} = '80') OR ({scheme(u)} = 'https' AND {port} = '443') THEN {host(u)} ELSE {host(u)} || ':' || {port} END"


def origin(u: str) -> str:
    return f"({scheme(u)} || '://' || {netloc(u)})"


def segments(p: str) -> str:
    return f"list_filter(string_split({p}, '/'), lambda s: s <> '')"


def pairs(q: str) -> str:
    k = "CASE WHEN strpos(p, '=') > 0 THEN left(p, strpos(p, '=') - 1) ELSE p END"
    v = "CASE WHEN strpos(p, '=') > 0 THEN substr(p, strpos(p, '=') + 1) ELSE '' END"
    dec = lambda x: f"url_decode(replace({x}, '+', ' '))"
    return f"list_transform(list_filter(string_split({q}, '&'), lambda p: p <> ''), lambda p: struct_pack(k := {dec(k)}, v := {dec(v)}))"


def _joined(ps: str) -> str:
    enc = lambda x: f"replace(url_encode({x}), '%20', '+')"
    return f"array_to_string(list_transform(list_sort({ps}), lambda x: {enc('x.k')} || '=' || {enc('x.v')}), '&')"


def _assembled(u: str, p: str, ps: str) -> str:
    q = _joined(ps)
    return f"({scheme(u)} || '://' || {netloc(u)} || {p} || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END)"


def normalize(u: str) -> str:
    tracking = ", ".join(text(t) for t in rules.TRACKING_PARAMS)
    ps = f"list_filter({pairs(query(u))}, lambda y: NOT (starts_with(lower(y.k), 'utm_') OR lower(y.k) IN ({tracking})))"
    return _assembled(u, f"CASE WHEN {path(u)} IN ('', '/') THEN '/' ELSE rtrim({path(u)}, '/') END", ps)


def dedup_key(u: str) -> str:
    p = f"CASE WHEN rtrim({path(u)}, '/') = '' THEN '/' ELSE rtrim({path(u)}, '/') END"
    return f"CASE WHEN {scheme(u)} = '' OR {host(u)} = '' THEN '' ELSE {_assembled(u, p, pairs(query(u)))} END"


def suffix(x: str, ends: list[str]) -> str:
    return f"regexp_matches({x}, {text('(?:' + '|'.join(re.escape(e) for e in ends) + ')$')})"


def prefix(x: str, starts: list[str]) -> str:
    return f"regexp_matches({x}, {text('^(?:' + '|'.join(re.escape(e) for e in starts) + ')')})"


def critical_type(u: str) -> str:
    cases = " ".join(f"WHEN {any_of(f'lower({path(u)})', t)} THEN '{n}'" for n, t in rules.CRITICAL_TOKENS.items())
    return f"CASE {cases} END"


def boost(u: str) -> str:
    return f"CASE WHEN {any_of(f'lower({path(u)})', rules.PRIORITY_KEYWORDS)} THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END"


def template_signal(u: str) -> str:
    s = segments(path(u))
    return f"CASE WHEN len({s}) >= 2 THEN '/' || array_to_string(({s})[1:2], '/') WHEN {path(u)} = '' THEN '/' ELSE {path(u)} END"


def without_dots(p: str) -> str:
    """Dot segments of an absolute path, each .. together with the segment before it."""
    out = f"regexp_replace({p}, '/\\.(/|$)', '/', 'g')"
    for _ in range(4):
        out = f"regexp_replace({out}, '/[^/]+/\\.\\.(/|$)', '/')"
    return f"regexp_replace({out}, '^(/\\.\\.)+(/|$)', '/')"


def resolve(base: str, href: str) -> str:
    """References that begin with a scheme, //, /, ?, # or a relative path."""
    front = f"{scheme(base)} || '://' || {authority(base)}"
    tail = f"CASE WHEN {query(href)} <> '' THEN '?' || {query(href)} ELSE '' END || CASE WHEN {part(href, 5)} <> '' THEN '#' || {part(href, 5)} ELSE '' END"
    folder = f"regexp_extract({part(base, 3)}, '^(.*/)', 1)"
    base_query = f"CASE WHEN {query(base)} <> '' THEN '?' || {query(base)} ELSE '' END"
    return f"""CASE WHEN {href} = '' THEN {base} WHEN {scheme(href)} <> '' THEN {href}
      WHEN starts_with({href}, '//') THEN {scheme(base)} || ':' || {href}
      WHEN starts_with({href}, '#') THEN {front} || {part(base, 3)} || {base_query} || {href}
      WHEN starts_with({href}, '?') THEN {front} || {part(base, 3)} || {href}
      WHEN starts_with({href}, '/') THEN {front} || {without_dots(part(href, 3))} || {tail}
      ELSE {front} || {without_dots(f"({folder} || {part(href, 3)})")} || {tail} END"""


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def page_type(u: str, t: str, nav: str, hf: str) -> str:
    return f"CASE WHEN {any_of(f'lower({u})', rules.INTERACTION_URL_KEYWORDS)} OR {any_of(f'lower({t})', rules.INTERACTION_TEXT_KEYWORDS)} THEN 'interaction' WHEN {nav} OR {hf} OR contains(lower({u}), 'category') OR contains(lower({u}), 'page') THEN 'nav' ELSE 'standard' END"


def tier(kind: str) -> str:
    return f"CASE {kind} WHEN 'interaction' THEN 2 WHEN 'nav' THEN 3 ELSE 4 END"


def weight(kind: str) -> str:
    return f"CASE {kind} WHEN 'interaction' THEN 0.9::DOUBLE WHEN 'nav' THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END"


def skip_reason(u: str, seed_host: str, depth: int) -> str:
    p = f"lower({path(u)})"
    keys = f"list_transform({pairs(query(u))}, lambda z: lower(z.k))"
    deep = f"WHEN regexp_matches({p}, '{rules.PAGED_PATH}') THEN 'exclusion_rule'" if depth > 1 else ""
    deeper = f"WHEN list_has_any({keys}, ['page', 'offset', 'cursor']) THEN 'exclusion_rule'" if depth > 1 else ""
    deepest = f"WHEN regexp_matches({p}, '{rules.ARCHIVE_PATH}') THEN 'exclusion_rule'" if depth > 2 else ""
    return f"""CASE WHEN {prefix(f'lower({u})', rules.EXCLUDED_SCHEMES)} THEN 'exclusion_rule'
      WHEN {scheme(u)} NOT IN ('http', 'https') OR {host(u)} = '' THEN 'exclusion_rule' WHEN {host(u)} <> {seed_host} THEN 'external'
      WHEN {suffix(p, rules.EXCLUDED_EXTENSIONS)} THEN 'exclusion_rule' WHEN regexp_matches({p}, '{rules.LOW_VALUE_PATH}') THEN 'low_value_pattern' {deep}
      WHEN list_has_any({keys}, ['page', 'filter', 'sort']) THEN 'low_value_pattern' {deeper} {deepest} END"""


def anchors() -> str:
    """Anchors of the pages' lists: the tables' anchors all stand in <nav>, before any header or footer."""
    return r"""(SELECT page_id, url, i - 1 AS pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_extract(a, '>([^<]*)<', 1) AS text,
      strpos(html, '<nav') > 0 AND strpos(html, a) > strpos(html, '<nav') AND strpos(html, a) < strpos(html, '</nav') AS in_nav, FALSE AS in_header_footer
      FROM (SELECT page_id, url, html, unnest(l) AS a, unnest(range(1, len(l) + 1)) AS i FROM (
        SELECT page_id, url, html, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS l FROM pages)))"""
