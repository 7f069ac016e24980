"""Transactions: steps checked against state, then appended to the log as one batch, or not at all."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.errors import InvalidSpec, StrictScopeConflict, TransactionConflict
from loomspan.functions.scalar import canonical
from loomspan.operators.graph import Graph
from loomspan.operators.writes import Writer


@dataclass
class Scope:
    """A part of the graph with its own rule: eventual, local_transactional or coordinated by an authority."""

    root: str
    mode: str = "eventual"
    authority: str | None = None

    def covers(self, node: str) -> bool:
        return node == self.root or node.startswith(f"{self.root}/")


def policy_of(scopes: list[Scope], node: str) -> Scope | None:
    """The scope with the longest root over a node."""
    return max((s for s in scopes if s.covers(node)), key=lambda s: len(s.root), default=None)


@dataclass
class Transaction:
    """Steps in sequence; later steps see what earlier ones wrote."""

    graph: Graph
    actor: str
    scope: Scope | None = None
    steps: list[dict] = field(default_factory=list)

    def step(self, kind: str, path: str, **more) -> "Transaction":
        self.steps.append({"kind": kind, "path": path} | more)
        return self

    def commit(self, writer: Writer | None = None, versions: DataFrame | None = None) -> DataFrame:
        """The operations of all steps; a step that fails raises and nothing is written.

        `versions` (node, field, version) answers assert_revision.
        """
        writer = writer or Writer(self.actor)
        start = len(writer.ops)
        seen: dict[tuple[str, str], str | None] = {}
        if self.scope and self.scope.mode == "coordinated" and self.scope.authority != self.actor:
            raise StrictScopeConflict(f"{self.actor} is not the authority of {self.scope.root}")
        try:
            for s in self.steps:
                self._run(s, writer, seen, versions)
        except Exception:
            del writer.ops[start:]
            raise
        return self.graph.spark.createDataFrame(writer.ops[start:], writer.frame(self.graph.spark).schema)

    def _run(self, s: dict, writer: Writer, seen: dict, versions: DataFrame | None) -> None:
        node, _, name = s["path"].rpartition(".")
        if self.scope and not self.scope.covers(node.split(".")[0]):
            raise StrictScopeConflict(f"{s['path']} is outside of {self.scope.root}")
        kind = s["kind"]
        if kind == "put":
            writer.put(node, name, s["value"])
            seen[node, name] = canonical(s["value"])
        elif kind == "unset":
            writer.unset(node, name)
            seen[node, name] = None
        elif kind == "set":
            writer.add(node, name, s["value"])
        elif kind == "remove":
            writer.remove(node, name, s["value"])
        elif kind == "increment":
            now = self._value(node, name, seen)
            value = 0 if now is None else json.loads(now)
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise TransactionConflict(f"{s['path']} is no number")
            writer.put(node, name, value + s["by"])
            seen[node, name] = canonical(value + s["by"])
        elif kind in ("assert_exists", "assert_absent", "assert_value"):
            now = self._value(node, name, seen)
            ok = {"assert_exists": now is not None, "assert_absent": now is None, "assert_value": now is not None and now == canonical(s.get("value"))}[kind]
            if not ok:
                raise TransactionConflict(f"{kind} {s['path']}")
        elif kind == "assert_revision":
            row = versions.where((F.col("node") == node) & (F.col("field") == name)).first() if versions is not None else None
            if row is None or tuple(row["version"])[:3] != tuple(s["revision"]):
                raise TransactionConflict(f"assert_revision {s['path']}")
        else:
            raise InvalidSpec(f"not a step: {s}")

    def _value(self, node: str, name: str, seen: dict) -> str | None:
        if (node, name) in seen:
            return seen[node, name]
        row = self.graph.fields.where((F.col("node") == node) & (F.col("field") == name)).first()
        return None if row is None else row["value"]


def increment(df: DataFrame, column: str, by: float, where=None) -> DataFrame:
    """A whole column incremented; absent counts as 0."""
    new = F.coalesce(F.col(column), F.lit(0)) + F.lit(by)
    return df.withColumn(column, new if where is None else F.when(where, new).otherwise(F.col(column)))


def preconditions(wanted: DataFrame, state: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """`wanted` (key, kind, expected) with `ok`: exists, absent, or value equal to what is expected."""
    now = state.select(F.col(key), F.col(value).alias("__now"), F.lit(True).alias("__there"))
    out = wanted.join(now, key, "left")
    there = F.coalesce("__there", F.lit(False))
    ok = F.when(F.col("kind") == "exists", there).when(F.col("kind") == "absent", ~there).otherwise(there & F.col("__now").eqNullSafe(F.col("expected")))
    return out.withColumn("ok", ok).drop("__now", "__there")
