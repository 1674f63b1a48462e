"""Named queries over the standard tables, each with its SQL equivalent."""

from __future__ import annotations

from . import audit_queries, crawl_queries, url_queries

_MODULES = [url_queries, audit_queries, crawl_queries]
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
