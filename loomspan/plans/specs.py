"""Specifications as plain dictionaries, checked and filled with their defaults.

Key names and defaults are fixed values: callers pass these dictionaries as they are.
"""

from __future__ import annotations

from loomspan.errors import InvalidSpec

QUERY = {"filters": [], "order": None, "limit": None, "offset": 0}
LEX = {"prefix": None, "start_at": None, "start_after": None, "end_at": None, "end_before": None, "reverse": False, "limit": None, "depth": 1, "follow_links": False}
RECORD_SCAN = {"prefix": None, "startAt": None, "startAfter": None, "endAt": None, "endBefore": None, "reverse": False, "limit": None, "cursor": None}
TRAVERSAL = {
    "direction": "outbound", "strategy": "bfs", "maxDepth": 1, "limit": 1024, "edgeFields": None, "followLinks": True, "followSets": True,
    "includeStart": False, "includeValues": False, "filters": [], "fetchMissing": True, "maxFetches": 64,
}
TEXT_SEARCH = {
    "limit": None, "offset": None, "fields": None, "includeMetadata": False, "includeSnippets": False, "explain": False, "exact": True,
    "stalePolicy": "refresh", "candidateLimit": None, "candidatePolicy": "reject_paginated_query",
}
VECTOR_SEARCH = {"limit": None, "ef": None, "filter": None, "includeVector": False, "includeMetadata": False, "exact": False, "stalePolicy": "fallback_exact"}
FILTER_KINDS = ("eq", "ne", "gt", "gte", "lt", "lte", "prefix", "contains", "exists")


def filled(spec: dict | None, defaults: dict) -> dict:
    """`spec` over `defaults`; unknown keys are errors."""
    spec = spec or {}
    if unknown := set(spec) - set(defaults):
        raise InvalidSpec(f"unknown keys: {sorted(unknown)}")
    return defaults | spec


def query(spec: dict | None) -> dict:
    out = filled(spec, QUERY)
    for f in out["filters"]:
        if f.get("kind") not in FILTER_KINDS or "path" not in f or (f["kind"] != "exists" and "value" not in f):
            raise InvalidSpec(f"not a filter: {f}")
    if out["order"] and out["order"].get("direction", "asc") not in ("asc", "desc"):
        raise InvalidSpec(f"not an order: {out['order']}")
    return out


def traversal(spec: dict | None) -> dict:
    out = filled(spec, TRAVERSAL)
    if out["direction"] not in ("outbound", "inbound", "both") or out["strategy"] not in ("bfs", "dfs"):
        raise InvalidSpec(f"not a traversal: {out['direction']}, {out['strategy']}")
    return out
