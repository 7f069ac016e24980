"""Every registered query of the engine with its DuckDB equivalent."""

from __future__ import annotations

from loomspan.plans import q_graph, q_more, q_search, q_state

_MODULES = (q_graph, q_state, q_search, q_more)


def queries():
    """Name -> callable(spark, sf_dir) -> DataFrame."""
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    """Name -> DuckDB SQL, for each query that SQL can express."""
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
