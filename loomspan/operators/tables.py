"""Ordinary tables seen as a graph: a table is a set, a row a node `table/<pk>`, a foreign key a link.

Dotted paths compile to left joins, one for each link prefix that some filter, order or output mentions. Small link
targets are left to the optimiser to broadcast by their size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.errors import InvalidSpec, TraversalIntoScalar
from loomspan.functions.scalar import Native, Value
from loomspan.operators import predicates
from loomspan.plans import specs


@dataclass(frozen=True)
class Table:
    """A table of nodes: its primary key and links as field -> (foreign key column, target table)."""

    name: str
    df: DataFrame
    pk: str
    links: dict[str, tuple[str, str]] = field(default_factory=dict)


class TableGraph:
    """Tables by name."""

    def __init__(self, *tables: Table):
        self.tables = {t.name: t for t in tables}

    def find(self, name: str) -> "TableQuery":
        return TableQuery(self, self.tables[name])

    def node_id(self, name: str, key: Column) -> Column:
        return F.concat(F.lit(f"{name}/"), key.cast("string"))

    def get(self, name: str, key, select: dict[str, str] | None = None) -> DataFrame:
        """The row of one node."""
        table = self.tables[name]
        return TableQuery(self, table, base=table.df.where(table.df[table.pk] == F.lit(key))).run({}, select)

    def map(self, name: str) -> DataFrame:
        """key and value (JSON with sorted fields) of all members."""
        return self.find(name).run({})

    def node_state(self, name: str, key) -> DataFrame:
        """Rows (node, field, kind, value) of one node: its scalars and links."""
        table = self.tables[name]
        row = table.df.where(table.df[table.pk] == F.lit(key))
        foreign = {fk: (f, target) for f, (fk, target) in table.links.items()}
        parts = []
        for c in sorted(row.columns):
            if c in foreign:
                f, target = foreign[c]
                parts.append(F.struct(F.lit(f).alias("field"), F.lit("link").alias("kind"), self.node_id(target, F.col(c)).alias("value")))
            else:
                parts.append(F.struct(F.lit(c).alias("field"), F.lit("scalar").alias("kind"), F.col(c).cast("string").alias("value")))
        return row.select(self.node_id(name, F.col(table.pk)).alias("node"), F.explode(F.array(*parts)).alias("f")).select("node", "f.field", "f.kind", "f.value").where("value IS NOT NULL")

    def edges(self, *names: str) -> DataFrame:
        """(source, field, target, kind) of all links of the given tables, or of all."""
        out = None
        for name in names or self.tables:
            table = self.tables[name]
            for f, (fk, target) in table.links.items():
                own = table.df.where(F.col(fk).isNotNull()).select(self.node_id(name, F.col(table.pk)).alias("source"), F.lit(f).alias("field"), self.node_id(target, F.col(fk)).alias("target"), F.lit("link").alias("kind"))
                out = own if out is None else out.unionByName(own)
        if out is None:
            raise InvalidSpec("no links")
        return out

    def nodes(self, *names: str) -> DataFrame:
        """Ids of all nodes of the given tables, or of all."""
        out = None
        for name in names or self.tables:
            table = self.tables[name]
            own = table.df.select(self.node_id(name, F.col(table.pk)).alias("node"))
            out = own if out is None else out.unionByName(own)
        return out


class TableQuery:
    """Immutable builder of a query over one table's rows."""

    def __init__(self, graph: TableGraph, table: Table, spec: dict | None = None, base: DataFrame | None = None):
        self.graph, self.table, self.base = graph, table, base if base is not None else table.df
        self.spec = specs.query(spec)

    def _with(self, **changes) -> "TableQuery":
        return TableQuery(self.graph, self.table, self.spec | changes, self.base)

    def where(self, kind: str, path: str, value=None) -> "TableQuery":
        f = {"kind": kind, "path": path} | ({} if kind == "exists" else {"value": value})
        return self._with(filters=[*self.spec["filters"], f])

    def __getattr__(self, name: str):
        if name.startswith("where_") and name[6:] in specs.FILTER_KINDS:
            return lambda path, value=None: self.where(name[6:], path, value)
        raise AttributeError(name)

    def order_by(self, path: str, direction: str = "asc") -> "TableQuery":
        return self._with(order={"path": path, "direction": direction})

    def limit(self, n: int | None) -> "TableQuery":
        return self._with(limit=n)

    def offset(self, n: int) -> "TableQuery":
        return self._with(offset=n)

    def first(self, select: dict[str, str] | None = None) -> DataFrame:
        return self.limit(1).run(None, select)

    def run(self, spec: dict | None = None, select: dict[str, str] | None = None) -> DataFrame:
        """`key` and `value`, or `key` and the paths of `select` (output name -> path).

        Links that only the output mentions are joined after the page is cut.
        """
        spec = specs.query(spec) if spec is not None else self.spec
        walk = _Walk(self.graph, self.table, self.base)
        condition = predicates.conjunction(spec["filters"], walk.value)
        order, descending = [], False
        if spec["order"]:
            descending = spec["order"].get("direction", "asc") == "desc"
            order = walk.value(spec["order"]["path"]).order(descending)
        rows = walk.df if condition is None else walk.df.where(condition)
        rows = predicates.paged(rows, [*order, walk.key], spec["offset"], spec["limit"])
        walk.df = rows
        if select is None:
            own = [F.col(f"r.{c}").alias(c) for c in sorted(self.table.df.columns)]
            return rows.select(walk.key.alias("key"), F.to_json(F.struct(walk.key.alias("$id"), *own)).alias("value"))
        columns = [walk.value(path).column.alias(name) for name, path in select.items()]
        return walk.df.select(walk.key.alias("key"), *columns)


class _Walk:
    """A table's rows as struct `r`, with link targets joined as further structs when a path first needs them."""

    def __init__(self, graph: TableGraph, table: Table, base: DataFrame):
        self.graph, self.table = graph, table
        self.df = base.select(F.struct(*[base[c] for c in base.columns]).alias("r"))
        self.key = graph.node_id(table.name, F.col(f"r.{table.pk}"))
        self.joined: dict[str, str] = {}

    def value(self, path: str) -> Value:
        if path == "$key":
            return Native(self.key, T.StringType())
        if path in ("", "$value"):
            return Native(F.to_json(F.col("r")), T.StringType())
        table, name, prefix = self.table, "r", ""
        segments = path.split(".")
        for i, s in enumerate(segments):
            last = i == len(segments) - 1
            if s == "$id" and last:
                return Native(self.graph.node_id(table.name, F.col(f"{name}.{table.pk}")), T.StringType())
            if s in table.links:
                fk, target = table.links[s]
                if last:
                    return Native(self.graph.node_id(target, F.col(f"{name}.{fk}")), T.StringType())
                prefix = f"{prefix}.{s}"
                if prefix not in self.joined:
                    self.joined[prefix] = f"l{len(self.joined)}"
                    other = self.graph.tables[target]
                    right = other.df.select(F.col(other.pk).alias("__pk"), F.struct(*[other.df[c] for c in other.df.columns]).alias(self.joined[prefix]))
                    self.df = self.df.join(right, F.col(f"{name}.{fk}") == right["__pk"], "left").drop("__pk")
                table, name = self.graph.tables[target], self.joined[prefix]
            elif not last:
                raise TraversalIntoScalar(path)
            elif s not in table.df.columns:
                return Native(F.lit(None).cast("string"), T.StringType())
            else:
                return Native(F.col(f"{name}.{s}"), table.df.schema[s].dataType)
        raise InvalidSpec(path)
