"""Named node scripts: registered Python functions with granted capabilities and limits. Writes are returned as mutation rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from loomspan.errors import CapabilityDenied, InvalidSpec

CAPABILITIES = ("read", "query", "traverse", "write", "transaction")


@dataclass
class Script:
    path: str
    name: str
    run: Callable
    grants: frozenset[str]
    max_calls: int = 1000


class Facade:
    """What a script sees: reads of the graph, and writes that are only collected."""

    def __init__(self, graph, script: Script):
        self._graph, self._script, self._calls, self.mutations = graph, script, 0, []

    def _need(self, capability: str) -> None:
        self._calls += 1
        if capability not in self._script.grants:
            raise CapabilityDenied(f"{self._script.name} has no {capability}")
        if self._calls > self._script.max_calls:
            raise CapabilityDenied(f"{self._script.name} made more than {self._script.max_calls} calls")

    def get(self, path: str):
        self._need("read")
        return self._graph.get(path)

    def map(self, path: str) -> list:
        self._need("read")
        return self._graph.map(path).collect()

    def query(self, path: str, spec: dict) -> list:
        self._need("query")
        return self._graph.query(path, spec).collect()

    def traverse(self, path: str, spec: dict) -> list:
        self._need("traverse")
        return self._graph.traverse(path, spec).rows.collect()

    def _write(self, kind: str, path: str, value=None) -> None:
        self._need("transaction" if kind == "increment" else "write")
        self.mutations.append({"kind": kind, "path": path, "value": value})

    def put(self, path: str, value) -> None:
        self._write("put", path, value)

    def unset(self, path: str) -> None:
        self._write("unset", path)

    def set(self, path: str, member) -> None:
        self._write("set", path, member)

    def remove(self, path: str, member) -> None:
        self._write("remove", path, member)

    def increment(self, path: str, by: float) -> None:
        self._write("increment", path, by)


@dataclass
class Registry:
    """Scripts by (path, name)."""

    scripts: dict[tuple[str, str], Script] = field(default_factory=dict)

    def attach(self, path: str, name: str, run: Callable, grants=(), max_calls: int = 1000) -> None:
        if unknown := set(grants) - set(CAPABILITIES):
            raise InvalidSpec(f"unknown capabilities: {sorted(unknown)}")
        self.scripts[path, name] = Script(path, name, run, frozenset(grants), max_calls)

    def list(self, path: str) -> list[str]:
        return sorted(n for p, n in self.scripts if p == path)

    def remove(self, path: str, name: str) -> bool:
        return self.scripts.pop((path, name), None) is not None

    def execute(self, graph, path: str, name: str, *args, dry_run: bool = False) -> tuple[object, list[dict]]:
        """The script's result, and the mutations it wants; none of them with `dry_run`."""
        script = self.scripts[path, name]
        facade = Facade(graph, script)
        result = script.run(facade, *args)
        return result, [] if dry_run else facade.mutations


def register_udf(spark, name: str, function: Callable, returns: str, vectorised: bool = True) -> None:
    """A user function for SQL and DataFrames, Arrow-batched unless asked otherwise."""
    from pyspark.sql.functions import pandas_udf, udf

    spark.udf.register(name, pandas_udf(function, returns) if vectorised else udf(function, returns))
