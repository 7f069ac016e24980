"""One handle on graph, records, text and vectors: small writes on the driver, everything else DataFrames.

Writes are collected as rows on the driver and folded with the log's table on demand; `flush` appends them to the table.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.errors import InvalidSpec, StrictScopeConflict, StrictScopeUnavailable, TraversalIntoScalar, TraversalIntoSet
from loomspan.functions.scripts import Registry
from loomspan.operators import fold, records, text, traverse, vector
from loomspan.operators.graph import Graph
from loomspan.operators.transactions import Scope, Transaction, policy_of
from loomspan.operators.writes import HybridClock, Writer
from loomspan.plans import specs
from loomspan.sources.tables import written

_RECORDS = "key string, kind string, json string, bytes binary, deleted boolean"


class Chain:
    """A path in the graph: reads are lazy, writes become pending operations."""

    def __init__(self, db: "Database", path: str):
        self.db, self.at = db, path

    def field(self, name: str) -> "Chain":
        return Chain(self.db, f"{self.at}.{name}")

    get = field

    def path(self, dotted: str) -> "Chain":
        return Chain(self.db, f"{self.at}.{dotted}")

    def back(self) -> "Chain":
        return Chain(self.db, self.at.rpartition(".")[0] or self.at)

    def once(self):
        """The value, deeply materialised; None if absent."""
        found = self.db.graph().get(self.at)
        return None if found is None else json.loads(found)

    load = open = once

    def is_absent(self) -> bool:
        return self.db.graph().cursor(self.at).kind == "absent"

    def map(self) -> DataFrame:
        return self.db.graph().map(self.at)

    def query(self, spec: dict | None = None) -> DataFrame:
        return self.db.graph().query(self.at, spec)

    def first(self, spec: dict | None = None) -> DataFrame:
        return self.db.graph().first(self.at, spec)

    def find(self) -> "Find":
        return Find(self)

    def lex(self, spec: dict | None = None) -> DataFrame:
        return self.db.graph().lex(self.at, spec)

    scan = lex

    def traverse(self, spec: dict | None = None) -> traverse.Traversal:
        return self.db.graph().traverse(self.at, spec)

    def _slot(self) -> tuple[str, str]:
        """The node and field that a write at this path goes to; nodes on the way that are missing are made and linked."""
        node, *way = self.at.split(".")
        if not way:
            return node, ""
        graph = self.db.graph()
        for i, name in enumerate(way[:-1]):
            at = graph.cursor(".".join([node, name]))
            if at.kind == "scalar":
                raise TraversalIntoScalar(self.at)
            if at.kind == "set":
                raise TraversalIntoSet(self.at)
            if at.kind == "absent":
                for missing in way[i:-1]:
                    self.db.writer.put(node, missing, {"$link": f"{node}/{missing}"})
                    node = f"{node}/{missing}"
                break
            node = at.node
        return node, way[-1]

    def put(self, value) -> "Chain":
        node, name = self._slot()
        if name:
            self.db.writer.put(node, name, value)
        else:
            self.db.writer.put_object(node, value)
        return self

    def unset(self) -> "Chain":
        self.db.writer.unset(*self._slot())
        return self

    def set(self, member) -> "Chain":
        """Adds a member: an id, a link, or an object with `$id`."""
        node, name = self._slot()
        if isinstance(member, dict) and "$id" in member:
            self.db.writer.put_object(member["$id"], {k: v for k, v in member.items() if k != "$id"})
            member = member["$id"]
        self.db.writer.add(node, name, member)
        return self

    def remove(self, member) -> "Chain":
        self.db.writer.remove(*self._slot(), member)
        return self


class Find:
    """Immutable builder of a query at a path."""

    def __init__(self, chain: Chain, spec: dict | None = None):
        self.chain, self.spec = chain, specs.query(spec)

    def _with(self, **more) -> "Find":
        return Find(self.chain, self.spec | more)

    def __getattr__(self, name: str):
        if name.startswith("where_") and name[6:] in specs.FILTER_KINDS:
            kind = name[6:]
            return lambda path, value=None: self._with(filters=[*self.spec["filters"], {"kind": kind, "path": path} | ({} if kind == "exists" else {"value": value})])
        raise AttributeError(name)

    def order_by(self, path: str, direction: str = "asc") -> "Find":
        return self._with(order={"path": path, "direction": direction})

    def limit(self, n: int | None) -> "Find":
        return self._with(limit=n)

    def offset(self, n: int) -> "Find":
        return self._with(offset=n)

    def run(self) -> DataFrame:
        return self.chain.query(self.spec)

    def first(self) -> DataFrame:
        return self.limit(1).run()


@dataclass
class Database:
    """State of one replica."""

    spark: SparkSession
    replica_id: str
    log_table: DataFrame | None = None
    record_table: DataFrame | None = None
    scopes: list[Scope] = field(default_factory=list)
    scripts: Registry = field(default_factory=Registry)

    def __post_init__(self):
        self.clock = HybridClock(self.replica_id)
        self.writer = Writer(self.replica_id, self.clock)
        self._records: list[tuple] = []
        self._texts: dict[str, dict] = {}
        self._requeued: DataFrame | None = None
        self.proposals: dict[str, dict] = {}
        self._vectors: dict[str, dict] = {}

    # graph

    def root(self, name: str) -> Chain:
        return Chain(self, name)

    chain = root

    def log(self) -> DataFrame:
        """All operations: the log's table and what is pending."""
        own = self.pending_operations()
        return (own if self.log_table is None else self.log_table.unionByName(own)).dropDuplicates(["op_id"])

    def graph(self) -> Graph:
        fields, members = fold.fold(self.log())
        return Graph(fields.withColumnRenamed("value_kind", "kind"), members)

    def node_state(self, node: str) -> DataFrame:
        return self.graph().node_state(node)

    def pending_operations(self) -> DataFrame:
        """What was written here or given back, and not drained since."""
        own = self.writer.frame(self.spark)
        return own if self._requeued is None else self._requeued.unionByName(own)

    def drain_pending_operations(self) -> DataFrame:
        """What is pending, now part of the table."""
        out = written(self.pending_operations(), "ops")
        self.log_table = out if self.log_table is None else self.log_table.unionByName(out)
        self.writer.ops.clear()
        self._requeued = None
        return out

    def requeue_operations(self, ops: DataFrame) -> None:
        """Drained operations that weren't delivered are pending again, each once; the state isn't changed by it."""
        ops = ops.dropDuplicates(["op_id"])
        if self._requeued is not None:
            ops = self._requeued.unionByName(ops.join(self._requeued.select("op_id"), "op_id", "left_anti").select(*self._requeued.columns))
        self._requeued = written(ops, "requeued")

    flush = drain_pending_operations

    def apply_operations(self, ops: DataFrame) -> None:
        """Operations of other replicas: those that policies accept, each once; the clock never falls behind them."""
        if self.scopes:
            policies = self.spark.createDataFrame([(s.root, s.mode, s.authority) for s in self.scopes], "scope string, mode string, authority string")
            ops = fold.authorised(ops, policies)
        fresh = written(ops.dropDuplicates(["op_id"]).join(self.log().select("op_id"), "op_id", "left_anti").select(*self.log().columns), "ops")
        newest = fresh.agg(F.max(F.struct("millis", "counter"))).first()[0]
        if newest is not None:
            self.clock.observe(*newest)
        self.log_table = fresh if self.log_table is None else self.log_table.unionByName(fresh)

    def configure_scope(self, root: str, mode: str, authority: str | None = None) -> Scope:
        if mode == "coordinated" and not authority:
            raise StrictScopeUnavailable(root)
        scope = Scope(root, mode, authority)
        self.scopes = [s for s in self.scopes if s.root != root] + [scope]
        return scope

    def policy(self, node: str) -> Scope | None:
        return policy_of(self.scopes, node)

    def transaction(self, scope: str | None = None) -> Transaction:
        found = next((s for s in self.scopes if s.root == scope), Scope(scope) if scope else None)
        return Transaction(self.graph(), self.replica_id, found)

    def commit(self, tx: Transaction) -> DataFrame:
        versions = fold.fold_fields(self.log()).select("node", "field", "version")
        return tx.commit(self.writer, versions)

    def propose(self, tx: Transaction, name: str) -> DataFrame:
        """The operations of a transaction whose scope another replica decides on: kept aside, not part of the state until accepted."""
        scope = tx.scope.authority if tx.scope else None
        free = Transaction(tx.graph, tx.actor, None, tx.steps)
        ops = written(free.commit(Writer(self.replica_id, self.clock)), "proposal")
        self.proposals[name] = {"ops": ops, "state": "pending", "authority": scope}
        return ops

    def provisional(self) -> Graph:
        """The state as it would be with all pending proposals."""
        log = self.log()
        for p in self.proposals.values():
            if p["state"] == "pending":
                log = log.unionByName(p["ops"].select(*log.columns))
        fields, members = fold.fold(log)
        return Graph(fields.withColumnRenamed("value_kind", "kind"), members)

    def decide(self, name: str, accept: bool, by: str) -> None:
        """The authority's word on a proposal: accepted, it becomes part of the log; rejected, it is dropped."""
        held = self.proposals[name]
        if held["state"] != "pending" or (held["authority"] and held["authority"] != by):
            raise StrictScopeConflict(f"{by} can't decide on {name}, which is {held['state']}")
        held["state"] = "accepted" if accept else "rejected"
        if accept:
            ops = held["ops"]
            self.log_table = ops if self.log_table is None else self.log_table.unionByName(ops.select(*self.log_table.columns))

    def run_script(self, path: str, name: str, *args, dry_run: bool = False):
        """A script's result; its mutations become one transaction."""
        result, wanted = self.scripts.execute(self.graph(), path, name, *args, dry_run=dry_run)
        tx = self.transaction()
        for m in wanted:
            tx.step(m["kind"], m["path"], **({"by": m["value"]} if m["kind"] == "increment" else {"value": m["value"]}))
        if wanted:
            self.commit(tx)
        return result

    # records

    def records(self) -> DataFrame:
        base = self.record_table if self.record_table is not None else self.spark.createDataFrame([], _RECORDS).drop("deleted")
        newest = list({r[0]: r for r in self._records}.values())
        return records.overlay(base, self.spark.createDataFrame(newest, _RECORDS))

    def put_record(self, key: str, value=None, data: bytes | None = None) -> None:
        self._records.append((key, "bytes" if data is not None else "json", None if data is not None else json.dumps(value), data, False))

    def delete_record(self, key: str) -> None:
        self._records.append((key, "json", None, None, True))

    def get_record(self, key: str) -> DataFrame:
        return records.get(self.records(), key)

    def get_many_records(self, keys: list[str]) -> DataFrame:
        return records.get_many(self.records(), keys)

    def scan_records(self, spec: dict | None = None) -> tuple[DataFrame, str | None]:
        """A page and the cursor behind it."""
        rows = self.records()
        return records.scan(rows, spec), records.next_cursor(rows, specs.filled(spec, specs.RECORD_SCAN))

    def apply_record_batch(self, batch: dict) -> dict[str, int]:
        out, report = records.apply_batch(self.records(), batch)
        self.record_table, self._records = written(out, "records"), []
        return report

    # text

    def create_text_collection(self, name: str, table: DataFrame | None = None, index: str | None = None, **config) -> None:
        """A collection over a table (id, fields, metadata), if given, and what is put beside it; `index`: folder of its stored postings."""
        self._texts[name] = {"config": text.collection_config(**config), "docs": {}, "table": table, "index": index}

    def put_text_document(self, collection: str, doc_id: str, fields: dict[str, str], **metadata) -> None:
        self._texts[collection]["docs"][doc_id] = (doc_id, fields, json.dumps(metadata))

    def delete_text_document(self, collection: str, doc_id: str) -> bool:
        there = self.get_text_document(collection, doc_id) is not None
        self._texts[collection]["docs"][doc_id] = None
        return there

    def get_text_document(self, collection: str, doc_id: str):
        """The row of a document; None if there is none."""
        return self.text_documents(collection).where(F.col("id") == doc_id).first()

    def text_documents(self, collection: str) -> DataFrame:
        return _beside(self.spark, self._texts[collection]["table"], self._texts[collection]["docs"], "id string, fields map<string,string>, metadata string")

    def text_search(self, source: str | dict, query: str, spec: dict | None = None) -> DataFrame:
        """Searches a collection (its name or kind), the entries of a graph query, or the records of a scan."""
        if isinstance(source, str):
            source = {"kind": "collection", "collection": source}
        if source["kind"] == "collection":
            held = self._texts[source["collection"]]
            docs = self.text_documents(source["collection"])
            return text.search(docs, query, spec, held["config"]) if held["index"] is None else text.search_stored(docs, held["index"], query, spec, held["config"])
        if source["kind"] == "query":
            wanted = specs.query(source.get("spec"))
            rows, cut = self.graph().query(source["path"], wanted), wanted["limit"] is not None or bool(wanted["offset"]) or bool(wanted["order"])
        elif source["kind"] == "records":
            wanted = specs.filled(source.get("scan"), specs.RECORD_SCAN)
            rows, cut = records.scan(self.records(), wanted).select("key", F.col("json").alias("value")), wanted["limit"] is not None
        else:
            raise InvalidSpec(f"not a source: {source}")
        only = (spec or {}).get("fields")
        docs = rows.select(F.col("key").alias("id"), text.string_leaves(F.col("value"), only).alias("fields"), F.col("key").alias("ordinal"))
        return text.search(text.candidates(docs, (spec or {}) | {"fields": None}, preselected=cut), query, (spec or {}) | {"fields": None})

    def text_index_stats(self, collection: str) -> DataFrame:
        return text.stats(self.text_documents(collection), self._texts[collection]["config"])

    # vectors

    def create_vector_collection(self, name: str, dim: int, metric: str = "l2", table: DataFrame | None = None) -> None:
        """A collection over a table (id, embedding, metadata map), if given, and what is put beside it."""
        if dim < 1 or metric not in vector.METRICS:
            raise InvalidSpec(f"{dim}, {metric}")
        self._vectors[name] = {"dim": dim, "metric": metric, "items": {}, "table": table, "deleted": 0}

    def put_vector(self, collection: str, item: str, values: list[float], **metadata) -> None:
        held = self._vectors[collection]
        held["items"][item] = (item, vector.validated(values, held["dim"], 1), {k: str(v) for k, v in metadata.items()})

    def delete_vector(self, collection: str, item: str) -> bool:
        held = self._vectors[collection]
        gone = self.get_vector(collection, item) is not None
        held["items"][item] = None
        held["deleted"] += gone
        return gone

    def get_vector(self, collection: str, item: str):
        """The row of a vector; None if there is none."""
        return self.vectors(collection).where(F.col("id") == item).first()

    def vectors(self, collection: str) -> DataFrame:
        return _beside(self.spark, self._vectors[collection]["table"], self._vectors[collection]["items"], "id string, embedding array<double>, metadata map<string,string>")

    def search_vectors(self, collection: str, query: list[float], spec: dict) -> DataFrame:
        held = self._vectors[collection]
        rows = self.vectors(collection)
        tests = ((spec.get("filter") or {}).get("metadata")) or {}
        names = sorted({k for t in ("eq", "prefix") for k in (tests.get(t) or {})} | set(tests.get("exists") or []))
        rows = rows.withColumns({f"meta_{k}": F.col("metadata")[k] for k in names})
        return vector.search(rows, query, spec, held["metric"], metadata={k: f"meta_{k}" for k in names} | ({"metadata": "metadata"} if spec.get("includeMetadata") else {}), dim=held["dim"])

    def vector_index_stats(self, collection: str) -> DataFrame:
        held = self._vectors[collection]
        return self.vectors(collection).agg(F.count("*").alias("vectors"), F.lit(held["deleted"]).cast("long").alias("deleted"), F.lit(0).cast("long").alias("incomplete"))


def _beside(spark: SparkSession, table: DataFrame | None, changed: dict[str, tuple | None], schema: str) -> DataFrame:
    """A table with the rows that were put since; ids that are None are deleted."""
    own = spark.createDataFrame([row for row in changed.values() if row is not None], schema)
    if table is None:
        return own
    ids = spark.createDataFrame([(i,) for i in changed], "id string")
    return table.select(*own.columns).join(ids, "id", "left_anti").unionByName(own)
