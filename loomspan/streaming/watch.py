"""Live results over a streamed operation log: recomputed per micro-batch, emitted when they change.

A watch is a function state -> DataFrame and a test on a batch's operations. The micro-batch coalesces bursts, equal
watches share one computation, and a result goes out only if its content hash differs from the last one's.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators import fold


#: Results and change events that wait at most.
KEEP = 64


def content_hash(df: DataFrame) -> str:
    """A hash of a result's rows, whatever their order: a sum of row hashes, so nothing is gathered."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}:{row['h']}"


def change_event(batch: DataFrame) -> DataFrame:
    """One row of a batch of operations: its newest revision, number of operations, touched paths and nodes."""
    return batch.agg(F.max(F.struct("millis", "counter", "actor")).alias("revision"), F.count("*").alias("pending_ops"), F.sort_array(F.collect_set(F.concat_ws(".", "node", "field"))).alias("touched_paths"), (F.count("*") > 0).alias("data_changed"))


def merged_events(events: DataFrame) -> DataFrame:
    """Several change events as one: newest revision, flags or-ed, paths united."""
    return events.agg(F.max("revision").alias("revision"), F.sum("pending_ops").alias("pending_ops"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("touched_paths")))).alias("touched_paths"), F.bool_or("data_changed").alias("data_changed"))


def overlaps(path: str) -> Column:
    """Whether an operation touches a path: either lies under the other."""
    own = F.concat_ws(".", "node", "field")
    return (own == path) | own.startswith(f"{path}.") | own.startswith(f"{path}/") | F.lit(path).startswith(F.concat(own, F.lit("."))) | (F.col("node") == path)


@dataclass
class Watch:
    """compute(log) -> DataFrame; `touched` filters operations that can change the result (None: all); equal keys share.

    Of the results that nobody has taken yet only the newest `keep` are kept.
    """

    key: str
    compute: Callable[[DataFrame], DataFrame]
    touched: Column | None = None
    results: deque = field(default_factory=deque)
    last: str | None = None
    keep: int = KEEP

    def __post_init__(self):
        self.results = deque(self.results, maxlen=self.keep)


class Watcher:
    """Runs watches over a stream of operations; the log so far is a table that each batch extends."""

    def __init__(self, spark, log_path: str, watches: list[Watch]):
        self.spark, self.log_path, self.watches = spark, log_path, watches
        self.events: deque = deque(maxlen=KEEP)
        self.computed = 0

    def _emit(self, log: DataFrame, batch: DataFrame | None) -> None:
        shared: dict[str, tuple[str, list]] = {}
        for w in self.watches:
            if batch is not None and w.touched is not None and w.last is not None and batch.where(w.touched).isEmpty():
                continue
            if w.key not in shared:
                result = w.compute(log).persist()
                self.computed += 1
                shared[w.key] = content_hash(result), [r.asDict(recursive=True) for r in result.collect()]
                result.unpersist()
            digest, rows = shared[w.key]
            if digest != w.last:
                w.last = digest
                w.results.append(rows)

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch, idempotent: its operations are the log's partition of that number."""
        batch.write.mode("overwrite").parquet(f"{self.log_path}/batch={batch_id}")
        log = self.spark.read.parquet(self.log_path).drop("batch").dropDuplicates(["op_id"])
        self.events.append(change_event(batch).first())
        self._emit(log, batch)

    def run(self, ops: DataFrame, checkpoint: str, trigger: dict | None = None):
        """Starts the query; by default it ends when all that is there was read."""
        writer = ops.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def field_watch(node: str, name: str, keep: int = KEEP) -> Watch:
    """The value of one field."""
    compute = lambda log: fold.fold_fields(log.where((F.col("node") == node) & (F.col("field") == name))).select("value_kind", "value")
    return Watch(f"field:{node}.{name}", compute, overlaps(f"{node}.{name}"), keep=keep)


def state_watch(key: str, compute: Callable[[DataFrame, DataFrame], DataFrame], touched: Column | None = None) -> Watch:
    """Any function of the folded fields and members: a query, a traversal, a search."""
    return Watch(key, lambda log: compute(*fold.fold(log)), touched)


def windowed_counts(ops: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Operations per window of event time, late ones dropped behind the watermark. State of a fold must not be kept this way."""
    return ops.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("n"))


def newest_records(log: DataFrame) -> DataFrame:
    """Records of a log of puts and deletes (op_id, seq, key, kind, json, bytes, deleted): the last word on each key."""
    last = log.groupBy("key").agg(F.max_by(F.struct("kind", "json", "bytes", "deleted"), "seq").alias("r"))
    return last.where("NOT r.deleted").select("key", "r.kind", "r.json", "r.bytes")


def record_watch(spec: dict) -> Watch:
    """A page of a record scan, recomputed only when a key in its range is touched."""
    from loomspan.operators import records
    from loomspan.operators.predicates import key_range

    inside = key_range(F.col("key"), spec.get("prefix"), spec.get("startAt"), spec.get("startAfter"), spec.get("endAt"), spec.get("endBefore"))
    return Watch(f"records:{sorted(spec.items())}", lambda log: records.scan(newest_records(log), spec), inside)


def text_watch(query: str, spec: dict, fields: list[str] | None = None) -> Watch:
    """A text search over records whose JSON holds the documents."""
    from loomspan.operators import text

    def compute(log: DataFrame) -> DataFrame:
        docs = newest_records(log).select(F.col("key").alias("id"), text.string_leaves(F.col("json"), fields).alias("fields"))
        return text.search(docs, query, spec).select("id", F.round("score", 9).alias("score"))

    return Watch(f"text:{query}:{sorted(spec.items())}:{fields}", compute)


def vector_watch(query: list[float], spec: dict, metric: str = "l2") -> Watch:
    """A nearest-neighbour search over records whose JSON is an array of numbers."""
    from loomspan.operators import vector

    def compute(log: DataFrame) -> DataFrame:
        rows = newest_records(log).select(F.col("key").alias("id"), F.from_json("json", "array<double>").alias("embedding"))
        return vector.search(rows, query, spec, metric)

    return Watch(f"vector:{query}:{sorted(spec.items())}:{metric}", compute)


def traversal_watch(path: str, spec: dict) -> Watch:
    """A traversal over the folded state."""
    from loomspan.operators.graph import Graph

    def compute(fields: DataFrame, members: DataFrame) -> DataFrame:
        return Graph(fields.withColumnRenamed("value_kind", "kind"), members).traverse(path, spec).rows

    return state_watch(f"traverse:{path}:{sorted(spec.items(), key=str)}", compute)
