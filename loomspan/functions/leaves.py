"""String leaves of JSON documents: an unbounded recursion, so Arrow-batched Python."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql.functions import pandas_udf


def leaves(value, path: str = "") -> list[tuple[str, str]]:
    """(dotted path, string) in path order."""
    if isinstance(value, str):
        return [(path, value)]
    items = sorted(value.items()) if isinstance(value, dict) else [(str(i), v) for i, v in enumerate(value)] if isinstance(value, list) else []
    return [leaf for k, v in items for leaf in leaves(v, f"{path}.{k}" if path else k)]


def at_path(value, path: str):
    """The value behind a dotted path; whole numbers index arrays. None if absent."""
    for s in path.split("."):
        if isinstance(value, dict):
            value = value.get(s)
        elif isinstance(value, list) and s.isdigit() and int(s) < len(value):
            value = value[int(s)]
        else:
            return None
    return value


def fields_of(text: str | None, paths: list[str] | None) -> dict[str, str]:
    try:
        value = json.loads(text) if text else None
    except ValueError:
        return {}
    if paths is None:
        return {p or "$value": s for p, s in leaves(value)}
    out = {}
    for p in paths:
        found = leaves(at_path(value, p))
        if found:
            out[p] = " ".join(s for _, s in found)
    return out


def selected_leaves(paths: list[str] | None):
    """A vectorised function JSON text -> map of fields."""

    @pandas_udf("map<string,string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fields_of(t, paths))

    return run
