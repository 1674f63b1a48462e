"""Failure taxonomy as ordered CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .urls import any_of


def _text(raw: Column) -> Column:
    return F.lower(F.trim(F.coalesce(raw, F.lit(""))))


def csp_blocks_inline(csp: Column) -> Column:
    """Whether a content security policy forbids inline scripts.

    The last of repeated directives counts; default-src stands in for a
    missing script-src.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(csp, F.lit("")), ";"), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    named = lambda name: F.element_at(
        F.concat(F.array(F.lit("")), F.filter(parts, lambda t: F.element_at(F.split(t, r"\s+"), 1) == name)), -1
    )
    source = F.coalesce(F.nullif(named("script-src"), F.lit("")), named("default-src"))
    return (source != "") & ~source.contains("'unsafe-inline'") & ~source.contains("nonce-") & ~source.contains("sha256-")


def is_captcha(raw: Column, headers: Column | None = None) -> Column:
    text = _text(raw)
    if headers is not None:
        low = F.transform_keys(headers, lambda k, v: F.lower(F.trim(k)))
        text = F.concat_ws(" ", text, *[F.lower(F.coalesce(F.try_element_at(low, F.lit(h)), F.lit(""))) for h in rules.CAPTCHA_HEADERS])
    return any_of(text, rules.CAPTCHA_TOKENS)


def normalize_failure(raw: Column, status: Column | None = None, csp: Column | None = None, headers: Column | None = None) -> Column:
    """Canonical reason of a failure; text rules come before numeric 4xx and 5xx."""
    text = _text(raw)
    status = F.lit(None).cast("int") if status is None else status
    alias = F.lit(None).cast("string")
    for name, reason in rules.REASON_ALIASES.items():
        alias = F.when(text == name, reason).otherwise(alias)
    blocked = F.lit(False) if csp is None else F.coalesce(csp_blocks_inline(csp), F.lit(False))
    limited = F.coalesce(status == 429, F.lit(False)) | any_of(text, ["status code 429", "http status 429"])
    return (
        F.when(text.isin(rules.REASONS), text)
        .when(alias.isNotNull(), alias)
        .when(limited, "rate_limited")
        .when(F.coalesce(status == 403, F.lit(False)) | is_captcha(raw, headers), "bot_wall")
        .when(blocked, "csp_blocked")
        .when(any_of(text, rules.CSP_TOKENS), "csp_injection_blocked")
        .when(any_of(text, rules.CONNECT_TOKENS), "connectivity_blocked")
        .when(any_of(text, rules.NAVIGATION_TOKENS), "browser_navigation_failed")
        .when(any_of(text, rules.TIMEOUT_TOKENS), "render_timeout")
        .when(any_of(text, rules.EXTRACTION_TOKENS), "extraction_failed")
        .when(status >= 500, "connectivity_blocked")
        .when((status >= 400) & (status < 500), "bot_wall")
        .otherwise("engine_error")
    )


def normalize_reason(raw: Column) -> Column:
    """As normalize_failure, but '' for a blank."""
    return F.when(_text(raw) == "", "").otherwise(normalize_failure(raw))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def reason_message(reason: Column, detail: Column | None = None) -> Column:
    base = _lookup(normalize_failure(reason), rules.REASON_MESSAGES)
    if detail is None:
        return base
    return F.when(F.coalesce(detail, F.lit("")) == "", base).otherwise(F.concat(base, F.lit(" ("), detail, F.lit(")")))


def failure_action(reason: Column) -> Column:
    return F.coalesce(_lookup(reason, rules.FAILURE_ACTIONS), F.lit("count_failure"))


def adaptive_action(reason: Column) -> Column:
    """What the crawl does next: slow_down, stop, static_only or continue."""
    return _lookup(failure_action(reason), rules.ADAPTIVE_ACTIONS)


def failure_severity(reason: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in rules.FAILURE_SEVERITY.items() for x in pair]), reason)


def fetch_status(fetch: Column, audit: Column) -> Column:
    """Status of a fetch result: its own, else the audit's, else success."""
    return F.coalesce(F.nullif(fetch, F.lit("")), F.nullif(audit, F.lit("")), F.lit("success"))


def exception_status(reason: Column) -> Column:
    return F.when(reason == "render_timeout", "timeout").when(reason == "bot_wall", "blocked").otherwise("error")


def crawl_status(stop_reason: Column, queue_remaining: Column) -> Column:
    return F.when(stop_reason.isin("failure_threshold", "global_timeout"), "aborted").when(queue_remaining, "partial").otherwise("completed")
