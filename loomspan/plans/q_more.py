"""Queries of path values at scale, text sources, stored indexes, vectors from chunks, logs, transactions, routing, helpers, watches."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from loomspan import errors
from loomspan.database import Database
from loomspan.functions import strings
from loomspan.functions.scalar import typed
from loomspan.operators import fanin, fold, routing, text, vector
from loomspan.operators.graph import Graph
from loomspan.plans.data import ops, read, tables, world
from loomspan.plans.data import records as event_records
from loomspan.plans.q_search import _BEST, _MSG_ROWS, _bm25, _two_fields
from loomspan.plans.q_state import _E, _REC, _scan, _stream_source
from loomspan.sources import oplog, snapshots
from loomspan.sources.tables import importable, shared_dir
from loomspan.streaming import watch


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# graph: paths that end at links and sets, over orders and customers


def shop(spark, sf_dir) -> Graph:
    """Orders and customers as state: `shop.orders` holds all orders, each links to its customer, and each customer has a set of orders."""
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    o, c = F.concat(F.lit("orders/"), "o_orderkey"), F.concat(F.lit("customer/"), "c_custkey")
    field = lambda df, node, name, kind, value: df.select(node.alias("node"), F.lit(name).alias("field"), F.lit(kind).alias("kind"), value.alias("value"))
    fields = field(orders, o, "status", "scalar", F.concat(F.lit('"'), "o_orderstatus", F.lit('"'))).unionByName(field(orders, o, "customer", "link", F.concat(F.lit("customer/"), "o_custkey")))
    fields = fields.unionByName(field(customer, c, "name", "scalar", F.concat(F.lit('"'), "c_name", F.lit('"'))))
    marked = customer.where("c_custkey % 5 < 4")
    fields = fields.unionByName(field(marked, c, "mark", "scalar", F.when(F.col("c_custkey") % 5 == 0, F.lit("true")).when(F.col("c_custkey") % 5 == 1, F.col("c_custkey").cast("string")).when(F.col("c_custkey") % 5 == 2, F.concat(F.lit('"'), "c_name", F.lit('"'))).otherwise(F.lit("null"))))
    members = orders.select(F.lit("shop").alias("node"), F.lit("orders").alias("field"), o.alias("member"))
    members = members.unionByName(customer.select(F.lit("shop").alias("node"), F.lit("customers").alias("field"), c.alias("member")))
    return Graph(fields, members)


def _by_link(kind):
    def run(spark, sf_dir):
        value = {"$id": "customer/42", "mark": "Customer#000000042", "name": "Customer#000000042"}
        return shop(spark, sf_dir).query("shop.orders", {"filters": [{"kind": kind, "path": "customer", "value": value}, {"kind": "eq", "path": "status", "value": "F"}]}, max_depth=1).select("key")

    return run


def q_eq_set(spark, sf_dir):
    """Nodes whose set equals a list of members: only `world` has one."""
    g = world(spark, sf_dir)
    root = Graph(g.fields.unionByName(spark.createDataFrame([("top", "w", "link", "world")], g.fields.schema)), g.members)
    regions = [{"$id": f"region/{i}", "name": r["r_name"], "rank": i} for i, r in enumerate(read(spark, sf_dir, "region").orderBy("r_regionkey").collect())]
    by = {"filters": [{"kind": "eq", "path": "regions", "value": {"$set": regions}}]}
    return root.query("top", by).select("key")


def q_order_mixed(spark, sf_dir):
    """A column of booleans, numbers, strings, nulls and nothing, in the order of types: the first of each and what is between."""
    return shop(spark, sf_dir).query("shop.customers", {"order": {"path": "mark"}, "offset": 200, "limit": 1000}, max_depth=0).select("key")


def _walk(path, spec):
    return lambda spark, sf_dir: shop(spark, sf_dir).traverse(path, {"limit": None, "includeStart": True} | spec).rows.select("node", F.col("depth").cast("int").alias("depth"))


def trav_filter_set(spark, sf_dir):
    return world(spark, sf_dir).traverse("world", {"maxDepth": 1, "limit": None, "includeStart": True, "filters": [{"kind": "exists", "path": "nations"}]}).rows.select("node")


def path_resolution(spark, sf_dir):
    """Where paths lead, and the errors of those that lead nowhere."""
    g, rows = world(spark, sf_dir), []
    for path in ("world", "world.nations", "nation/3", "nation/3.name", "nation/3.region", "nation/3.region.name", "nation/3.none", "nation/3.none.more", "nation/3.name.first", "world.nations.name"):
        try:
            at = g.cursor(path)
            rows.append((path, at.kind, at.value if at.kind == "scalar" else at.node))
        except errors.LoomError as e:
            rows.append((path, type(e).__name__, None))
    return spark.createDataFrame(rows, "path string, outcome string, value string")


# text


def _part_json(spark, sf_dir):
    value = F.to_json(F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("made"), F.array("p_type", "p_brand").alias("tags")))
    return read(spark, sf_dir, "part").select("p_partkey", value.alias("json"))


def text_leaves(spark, sf_dir):
    """String leaves of nested JSON by dotted path."""
    return _part_json(spark, sf_dir).select("p_partkey", F.explode(text.string_leaves(F.col("json"))).alias("path", "leaf"))


def text_leaves_selected(spark, sf_dir):
    return _part_json(spark, sf_dir).select("p_partkey", F.explode(text.string_leaves(F.col("json"), ["made", "tags.1", "none"])).alias("path", "leaf"))


def text_records_source(spark, sf_dir):
    """A search over the records of a scan: JSON values are the documents."""
    rows = _part_json(spark, sf_dir).select(F.concat(F.lit("part/"), "p_partkey").alias("key"), F.lit("json").alias("kind"), "json", F.lit(None).cast("binary").alias("bytes"))
    db = Database(spark, "a", record_table=rows)
    return db.text_search({"kind": "records", "scan": {"prefix": "part/1"}}, "ring economy", {"limit": 20, "fields": ["name", "tags"]}).select("id", F.round("score", 6).alias("score"))


def _candidate_rows(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), F.col("conv_id").alias("id"), F.create_map(F.lit("text"), F.col("text")).alias("fields"))


def text_counts(spark, sf_dir):
    """Candidates offered and searched, cut and not cut."""
    rows = _candidate_rows(spark, sf_dir)
    cut, whole = (text.candidate_counts(rows, {"candidateLimit": n}) for n in (50, 100_000_000))
    return cut.unionByName(whole)


def text_explain(spark, sf_dir):
    return text.search(_two_fields(spark, sf_dir), "the user", {"limit": 20, "explain": True}, digits=6).select("id", "explain")


def text_index_stored(spark, sf_dir):
    """Ranked by stored postings; the index is built by the first search and only read by the second."""
    path, docs = _folder(spark, "index"), _two_fields(spark, sf_dir)
    text.search_stored(docs, path, "the", {"limit": 1}).count()
    return text.search_stored(docs, path, "the user", {"limit": None, "stalePolicy": "reject"}, digits=6).select("id", "score")


def text_collection(spark, sf_dir):
    """A collection over a table, with one document replaced and another deleted."""
    c = _two_fields(spark, sf_dir)
    table = c.select(F.col("id").cast("string").alias("id"), "fields", F.lit("{}").alias("metadata"))
    db = Database(spark, "a")
    db.create_text_collection("messages", table=table, fields={"text": 1.0, "role": 1.0})
    db.put_text_document("messages", "1000", {"text": "the user of the user", "role": "user"})
    db.delete_text_document("messages", "1001")
    return db.text_search("messages", "the user", {"limit": 30}).select("id", F.round("score", 6).alias("score"))


# vectors


def _chunked(spark, sf_dir):
    """Embeddings as records: an item and four chunks each; every tenth lacks a chunk, every seventh is deleted, every fifth chunk comes twice."""
    e = read(spark, sf_dir, "embeddings")
    items = e.select(F.col("vec_id").alias("id"), F.size("embedding").alias("dim"), F.lit(4).alias("n_chunks"), (F.col("vec_id") % 7 == 0).alias("deleted"))
    chunks = e.select(F.col("vec_id").alias("id"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(k.alias("n"), F.slice(F.col("embedding").cast("array<double>"), k * 16 + 1, 16).alias("values")))).alias("c")).select("id", "c.*")
    chunks = chunks.where("NOT (id % 10 = 3 AND n = 2)")
    return items, chunks.unionByName(chunks.where("id % 5 = 1"))


def vec_assemble(spark, sf_dir):
    out = vector.assemble_chunks(*_chunked(spark, sf_dir))
    return out.select("id", "state", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


def vec_stats(spark, sf_dir):
    return vector.stats(vector.assemble_chunks(*_chunked(spark, sf_dir)))


def vec_stored(spark, sf_dir):
    """Neighbours in a stored collection that its source has outgrown, once as stored and once in the source."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    query, path = e.where("id = 7").first()["embedding"], _folder(spark, "vectors")
    from loomspan.sources import indexes

    indexes.build(e.where("id % 2 = 0"), path, vector.index_tables)
    found = [vector.search_stored(e, path, query, {"limit": 10, "stalePolicy": p}, dim=len(query)).select(F.lit(p).alias("policy"), "id", F.round("distance", 6).alias("distance")) for p in ("allow_stale", "fallback_exact")]
    return found[0].unionByName(found[1])


def vec_collection(spark, sf_dir):
    """A collection over a table: one vector deleted, one put, filtered by metadata."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))
    query = e.where("id = '7'").first()["embedding"]
    db = Database(spark, "a")
    db.create_vector_collection("v", len(query), table=e)
    db.delete_vector("v", "7")
    db.put_vector("v", "new", query, label="1")
    return db.search_vectors("v", query, {"limit": 10, "filter": {"metadata": {"eq": {"label": "1"}}}}).select("id", F.round("distance", 6).alias("distance"))


def errors_observed(spark, sf_dir):
    """The error that each wrong request meets."""
    e = read(spark, sf_dir, "embeddings")
    db = Database(spark, "a")
    db.create_vector_collection("v", 2)
    wrong = {
        "limit below one": lambda: vector.search(e, [0.0] * 64, {"limit": 0}, id_col="vec_id"), "wrong dimension": lambda: vector.search(e, [0.0], {"limit": 1}, id_col="vec_id", dim=64),
        "not finite": lambda: vector.search(e, [float("nan")] * 64, {"limit": 1}, id_col="vec_id"), "unknown metric": lambda: vector.search(e, [0.0] * 64, {"limit": 1}, "manhattan", "vec_id"),
        "put of a wrong dimension": lambda: db.put_vector("v", "x", [1.0]), "unknown key of a spec": lambda: text.search(e, "x", {"size": 3}), "preselected candidates": lambda: text.candidates(e, None, preselected=True),
        "unknown policy": lambda: text.search(e, "x", {"stalePolicy": "never"}), "path behind a scalar": lambda: world(spark, sf_dir).cursor("nation/1.name.x"), "path behind a set": lambda: world(spark, sf_dir).cursor("world.nations.x"),
        "coordinated scope without authority": lambda: db.configure_scope("s", "coordinated"), "list of objects": lambda: db.root("a").field("b").put([{"x": 1}]), "bytes that aren't base64": lambda: db.root("a").field("b").put({"$bytes": "?"}),
        "precondition that fails": lambda: db.apply_record_batch({"preconditions": [{"kind": "exists", "key": "none"}]}), "stale index": lambda: text.search_stored(_two_fields(spark, sf_dir), _folder(spark, "none"), "x", {"stalePolicy": "reject"}),
    }
    rows = []
    for name, f in wrong.items():
        try:
            f()
            rows.append((name, "none"))
        except errors.LoomError as x:
            rows.append((name, type(x).__name__))
    return spark.createDataFrame(rows, "request string, error string")


# logs, transactions, scopes


def oplog_roundtrip(spark, sf_dir):
    """Operations appended in two halves as JSON lines and read back."""
    path, log = _folder(spark, "ops"), ops(spark, sf_dir)
    oplog.append(log.where("millis % 2 = 0"), path)
    oplog.append(log.where("millis % 2 <> 0"), path)
    return oplog.read(spark, path).select("op_id", "author", "millis", "kind", "node", "field", "value_kind", F.col("value").cast("double").alias("value"))


def oplog_checkpoint(spark, sf_dir):
    """State folded from a log, written and read back."""
    return oplog.checkpoint(ops(spark, sf_dir), _folder(spark, "checkpoint"))[0].select("node", "field", F.col("value").cast("double").alias("value"))


def oplog_requeue(spark, sf_dir):
    """Writes drained, given back twice over, and drained again: each once."""
    db = Database(spark, "a")
    for i in range(5):
        db.root("n").field(f"f{i}").put(i)
    first = db.drain_pending_operations()
    db.requeue_operations(first.unionByName(first))
    db.requeue_operations(first)
    db.root("n").field("f5").put(5)
    return db.drain_pending_operations().select("node", "field", "value")


def fold_idempotent(spark, sf_dir):
    """A log delivered twice folds to the state of one delivery."""
    db, log = Database(spark, "a"), ops(spark, sf_dir)
    db.apply_operations(log)
    db.apply_operations(log.unionByName(log))
    return db.graph().fields.select("node", "field", F.col("value").cast("double").alias("value"))


def fold_redelivered(spark, sf_dir):
    """At-least-once delivery: every third operation again, in any order."""
    log = ops(spark, sf_dir)
    return fold.fold_fields(log.unionByName(log.where("CAST(op_id AS BIGINT) % 3 = 0")).repartition(5)).select("node", "field", F.col("value").cast("double").alias("value"))


def _events_db(spark, sf_dir):
    db = Database(spark, "a")
    db.apply_operations(ops(spark, sf_dir))
    return db


def tx_commit(spark, sf_dir):
    """Steps over the folded events: assertions, an increment, a put and an unset, committed as one; then one that fails and writes nothing."""
    db = _events_db(spark, sf_dir)
    user = read(spark, sf_dir, "events").where("event_type = 'click'").agg(F.min("user_id")).first()[0]
    at = f"user/{user}"
    db.commit(db.transaction().step("assert_exists", f"{at}.click").step("assert_absent", f"{at}.none").step("increment", f"{at}.click", by=1000.0).step("put", f"{at}.name", value="x").step("unset", f"{at}.view"))
    try:
        db.commit(db.transaction().step("put", f"{at}.lost", value=1).step("assert_value", f"{at}.name", value="y"))
        failed = False
    except errors.TransactionConflict:
        failed = True
    return db.graph().node_state(at).select("field", F.when(F.col("field") == "name", F.col("value")).otherwise(F.round(F.col("value").cast("double"), 6).cast("string")).alias("value"), F.lit(failed).alias("failed"))


def tx_proposals(spark, sf_dir):
    """Proposals on a coordinated scope: one accepted, one rejected, one pending, which only the provisional state shows."""
    db = _events_db(spark, sf_dir)
    db.configure_scope("user/1", "coordinated", "boss")
    for name in ("yes", "no", "later"):
        db.propose(db.transaction("user/1").step("put", f"user/1.{name}", value=name), name)
    db.decide("yes", True, "boss")
    db.decide("no", False, "boss")
    try:
        db.decide("later", True, "a")
    except errors.StrictScopeConflict:
        pass
    states = [(s, g.fields.where("node = 'user/1' AND field IN ('yes', 'no', 'later')")) for s, g in (("state", db.graph()), ("provisional", db.provisional()))]
    return states[0][1].select(F.lit(states[0][0]).alias("seen_in"), "field").unionByName(states[1][1].select(F.lit(states[1][0]).alias("seen_in"), "field"))


def script_run(spark, sf_dir):
    """A script with granted capabilities counts purchases above its argument and writes the count."""
    db = _events_db(spark, sf_dir)

    def run(node, least):
        node.put("report.count", int(db.graph().fields.where(f"field = 'purchase' AND CAST(value AS DOUBLE) > {least}").count()))
        return node.get("user/1.purchase") is not None

    db.scripts.attach("report", "count", run, ["read", "write"])
    db.run_script("report", "count", 50)
    return db.graph().node_state("report").select("field", F.col("value").cast("long").alias("value"))


def redact_hook(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return snapshots.redacted(rows, {"c_name": "hidden"}, deny=F.col("c_acctbal") < 0)


def chain_aliases(spark, sf_dir):
    """Other names of the same reads and writes."""
    db = Database(spark, "a")
    db.chain("n").get("x").put(1)
    db.root("n").path("y").put({"z": "deep"})
    at = db.root("n")
    got = {"once": at.field("x").once(), "load": at.get("x").load(), "open": at.path("y.z").open(), "back": at.path("y.z").back().field("z").once(), "scan": [r["key"] for r in at.scan().collect()], "map": [r["key"] for r in at.map().collect()], "absent": at.field("none").is_absent()}
    return spark.createDataFrame([(k, str(v)) for k, v in got.items()], "name string, value string")


# helpers


def str_names(spark, sf_dir):
    """Names in hex and back, joined and cleaned."""
    name = F.col("p_name")
    return read(spark, sf_dir, "part").select("p_partkey", strings.hex_component(name).alias("hex"), strings.unhex_component(strings.hex_component(name)).alias("back"), strings.join_path(F.col("p_type"), F.lit(""), F.col("p_brand")).alias("path"), strings.clean_actor(F.concat_ws("! ", name, "p_brand")).alias("actor"))


def str_sort_key(spark, sf_dir):
    """Balances, negative ones too, in the order of their keys."""
    rows = read(spark, sf_dir, "customer").withColumn("k", strings.sort_key(typed(F.col("c_acctbal").cast("string"))))
    return rows.orderBy("k", "c_custkey").limit(200).select("c_custkey", "c_acctbal")


def bin_floats(spark, sf_dir):
    """Vectors as bytes and back."""
    importable(spark)

    @pandas_udf("double")
    def total(v: pd.Series) -> pd.Series:
        return v.map(lambda x: float(sum(strings.bytes_to_floats(strings.floats_to_bytes(x)))))

    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(total("embedding"), 4).alias("total"))


# routing


def _routes(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("user_id") % 3 == 0, "broadcast").when(F.col("user_id") % 3 == 1, "peer").otherwise("topic")
    target = F.when(F.col("user_id") % 3 == 1, F.concat(F.lit("p"), F.col("user_id") % 10)).when(F.col("user_id") % 3 == 2, F.col("event_type"))
    return e.select("event_id", "user_id", kind.alias("target_kind"), target.alias("target"), F.col("event_type").alias("channel"), (F.col("event_id") % 4).alias("ttl"), F.array(F.lit("p0")).alias("seen_by"))


def route_target(spark, sf_dir):
    return routing.for_target(_routes(spark, sf_dir), "p4", ["click", "view"], "error").select("event_id")


def route_forward(spark, sf_dir):
    return routing.forwarded(_routes(spark, sf_dir), "me").select("event_id", "ttl", F.array_join("seen_by", ",").alias("seen_by"))


def route_recommend(spark, sf_dir):
    some = lambda n: F.slice(F.sequence(F.lit(1), F.lit(20)), 1, n.cast("int"))
    e = read(spark, sf_dir, "events")
    return e.select("event_id", routing.recommendation(some(F.col("event_id") % 12), some(F.col("user_id") % 11)).cast("long").alias("score"))


def route_recipients(spark, sf_dir):
    """Sessions of customers on the channels of events, but for the sender's."""
    channel = lambda k: F.concat(F.lit("c"), F.col(k) % 5000)
    routes = read(spark, sf_dir, "events").select(F.col("event_id").alias("route_id"), F.col("user_id").alias("sender"), channel("event_id").alias("channel"))
    sessions = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session"), (F.col("c_custkey") % 100).alias("session_peer"), channel("c_custkey").alias("channel"))
    return routing.recipients(routes, sessions)


def route_app(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("namespace"), F.lit("chat").alias("protocol"), F.concat(F.lit("t"), F.col("conv_id") % 3).alias("topic"))
    return routing.app_messages(c, namespace="user", protocol=None, topic="t1").select("conv_id", "turn")


def route_underlays(spark, sf_dir):
    """The 20 best transports."""
    paths = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("t"), F.col("s_nationkey") % 4).alias("transport"), (F.col("s_acctbal") > 5000).alias("direct"), (F.col("s_suppkey") % 7).alias("priority"))
    return routing.underlays(paths, ["t1", "t2", "t3"], "t2").limit(20).select("id", "transport", "direct", "priority")


def route_peers(spark, sf_dir):
    peers = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("peer"), F.array(F.concat(F.lit("text_collection:"), "p_brand"), F.concat(F.lit("size"), F.col("p_size") % 5)).alias("capabilities"))
    return routing.chosen_peers(peers, collection="Brand#17", capability="size1").select("peer", F.col("hint").cast("int").alias("hint"))


def route_batches(spark, sf_dir):
    items = read(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_id").alias("ordinal"))
    return routing.batches(items, "user_id", 4).select("event_id", F.col("batch").cast("long").alias("batch"))


def route_accepted(spark, sf_dir):
    grants = spark.createDataFrame([("actor0", "user/1"), ("actor1", "user/"), ("actor1", "user/2"), ("actor9", "user/")], "author string, prefix string")
    return routing.accepted(ops(spark, sf_dir), grants).select("op_id", "author", "node")


def fanin_gather(spark, sf_dir):
    """Rows of two peers, a third that failed, and one cursor for those that have more."""
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("e/"), "event_id").alias("key"))
    rows = fanin.union({"b": e.where("key LIKE '%1'"), "a": e.where("key LIKE '%2'")}).select("key", "peer", F.lit(None).cast("string").alias("error"))
    failed = fanin.failures(spark, {"c": "unreachable"}).select(F.lit(fanin.cursors({"a": "e/2", "b": None})).alias("key"), "peer", "error")
    return rows.unionByName(failed)


# watches


def _watch(spark, stream, *watches):
    base = _folder(spark, "watch")
    watcher = watch.Watcher(spark, f"{base}/log", list(watches))
    watcher.run(stream, f"{base}/checkpoint").awaitTermination()
    return watcher


def watch_field(spark, sf_dir):
    """The last value of one field, by two equal watches that share a computation, and how many results each gave."""
    one, same = watch.field_watch("user/1", "click"), watch.field_watch("user/1", "click")
    watcher = _watch(spark, _stream_source(spark, sf_dir), one, same)
    rows = [(r["value_kind"], float(r["value"]), len(one.results), len(same.results), watcher.computed) for r in same.results[-1]]
    return spark.createDataFrame(rows, "value_kind string, value double, given int, given_same int, computed int")


def watch_traverse(spark, sf_dir):
    """Nodes that a walk over a live graph meets: events link users to the next user."""
    e = ops(spark, sf_dir)
    links = e.withColumns({"value_kind": F.lit("link"), "field": F.lit("next"), "value": F.concat(F.lit("user/"), (F.substring("node", 6, 20).cast("long") + 1).cast("string"))})
    path = _folder(spark, "log")
    oplog.append(links, path)
    live = watch.traversal_watch("user/1", {"maxDepth": 5, "limit": None})
    _watch(spark, oplog.stream(spark, path), live)
    return spark.createDataFrame([(r["node"], r["depth"]) for r in live.results[-1]], "node string, depth int")


def _record_stream(spark, sf_dir, rows, name):
    path = _folder(spark, name)
    full = {"millis": F.col("seq"), "counter": F.lit(0).cast("long"), "actor": F.lit("a"), "node": F.col("key"), "field": F.lit("r"), "kind": F.lit("json"), "bytes": F.lit(None).cast("binary")}
    rows = rows.withColumns({k: v for k, v in full.items() if k not in rows.columns})
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def watch_record_page(spark, sf_dir):
    """A live page of records: each event puts its user's record, errors delete it."""
    e = read(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").cast("string").alias("op_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"), F.concat(F.lit("u/"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("key"), F.col("props").alias("json"), (F.col("event_type") == "error").alias("deleted"))
    live = watch.record_watch({"prefix": "u/", "startAfter": "u/00000010", "limit": 50})
    _watch(spark, _record_stream(spark, sf_dir, rows, "records"), live)
    return spark.createDataFrame([(r["key"], r["json"]) for r in live.results[-1]], "key string, json string")


def watch_text(spark, sf_dir):
    """A live search over records that hold messages."""
    c = read(spark, sf_dir, "conversations")
    rows = c.select(F.concat_ws("/", "conv_id", "turn").alias("op_id"), F.lit(1).cast("long").alias("seq"), F.concat_ws("/", "conv_id", "turn").alias("key"), F.to_json(F.struct("text")).alias("json"), F.lit(False).alias("deleted"))
    live = watch.text_watch("the user", {"limit": None})
    _watch(spark, _record_stream(spark, sf_dir, rows, "texts"), live)
    return spark.createDataFrame([(r["id"], round(r["score"], 6)) for r in live.results[-1]], "id string, score double")


def watch_vectors(spark, sf_dir):
    """A live search over records that hold vectors."""
    e = read(spark, sf_dir, "embeddings")
    query = e.where("vec_id = 7").first()["embedding"]
    rows = e.select(F.col("vec_id").cast("string").alias("op_id"), F.lit(1).cast("long").alias("seq"), F.col("vec_id").cast("string").alias("key"), F.to_json(F.col("embedding").cast("array<double>")).alias("json"), (F.col("vec_id") % 2 == 0).alias("deleted"))
    live = watch.vector_watch(query, {"limit": 10})
    _watch(spark, _record_stream(spark, sf_dir, rows, "vectors"), live)
    return spark.createDataFrame([(r["id"], round(r["distance"], 6)) for r in live.results[-1]], "id string, distance double")


_WAITING, _BATCHES = 2, 6


def watch_newest(spark, sf_dir):
    """A consumer that takes nothing: of many batches only the newest results wait, and an equal result isn't given again."""
    path, one = _folder(spark, "log"), ops(spark, sf_dir).where("node = 'user/1'").orderBy("op_id").limit(1)
    for i in range(_BATCHES):
        own = {"op_id": F.lit(f"n{i}"), "millis": F.lit(1 + i).cast("long"), "field": F.lit("x"), "value": F.lit(str(min(i, _BATCHES - 2)))}
        oplog.append(one.withColumns(own).coalesce(1), path)
    live = watch.field_watch("user/1", "x", keep=_WAITING)
    watcher = _watch(spark, oplog.stream(spark, path, max_files=1), live)
    return spark.createDataFrame([(len(live.results), live.results[-1][0]["value"], watcher.computed)], "waiting int, newest string, computed int")


QUERIES = {
    "rec_all_in_one_page": _scan({"prefix": "events/", "limit": 1_000_000_000}), "q_eq_link": _by_link("eq"), "q_ne_link": _by_link("ne"), "q_eq_set": q_eq_set, "q_order_mixed": q_order_mixed,
    "trav_filter_id": _walk("shop.orders", {"filters": [{"kind": "prefix", "path": "$id", "value": "customer/1"}]}), "trav_filter_link": _walk("shop.orders", {"filters": [{"kind": "eq", "path": "customer", "value": {"$link": "customer/42"}}]}),
    "trav_filter_dotted": _walk("shop.orders", {"maxDepth": 0, "filters": [{"kind": "eq", "path": "customer.$link", "value": "customer/7"}, {"kind": "ne", "path": "status", "value": "F"}]}), "trav_filter_set": trav_filter_set,
    "path_resolution": path_resolution, "text_leaves": text_leaves, "text_leaves_selected": text_leaves_selected, "text_records_source": text_records_source, "text_counts": text_counts, "text_explain": text_explain,
    "text_index_stored": text_index_stored, "text_collection": text_collection, "vec_assemble": vec_assemble, "vec_stats": vec_stats, "vec_stored": vec_stored, "vec_collection": vec_collection, "errors_observed": errors_observed,
    "oplog_roundtrip": oplog_roundtrip, "oplog_checkpoint": oplog_checkpoint, "oplog_requeue": oplog_requeue, "fold_idempotent": fold_idempotent, "fold_redelivered": fold_redelivered, "tx_commit": tx_commit, "tx_proposals": tx_proposals,
    "script_run": script_run, "redact_hook": redact_hook, "chain_aliases": chain_aliases, "str_names": str_names, "str_sort_key": str_sort_key, "bin_floats": bin_floats, "route_target": route_target, "route_forward": route_forward,
    "route_recommend": route_recommend, "route_recipients": route_recipients, "route_app": route_app, "route_underlays": route_underlays, "route_peers": route_peers, "route_batches": route_batches, "route_accepted": route_accepted,
    "fanin_gather": fanin_gather, "watch_field": watch_field, "watch_traverse": watch_traverse, "watch_record_page": watch_record_page, "watch_text": watch_text, "watch_vectors": watch_vectors, "watch_newest": watch_newest,
}

_ORDERS = "SELECT 'orders/' || o_orderkey AS key FROM orders"
_FOLDED = f"SELECT node, event_type AS field, arg_max(value, micros) AS value FROM {_E} GROUP BY node, event_type"
_PARTS = "SELECT 'part/' || p_partkey AS id, 'name' AS field, p_name AS text FROM part WHERE starts_with('part/' || p_partkey, 'part/1') UNION ALL SELECT 'part/' || p_partkey, 'tags', p_type || ' ' || p_brand FROM part WHERE starts_with('part/' || p_partkey, 'part/1')"
_CHANGED = f"""SELECT * FROM (SELECT CAST(id AS VARCHAR) AS id, field, text FROM ({_MSG_ROWS})) WHERE id NOT IN ('1000', '1001') UNION ALL SELECT '1000', 'text', 'the user of the user' UNION ALL SELECT '1000', 'role', 'user'"""
_STATE = "CASE WHEN vec_id % 7 = 0 THEN 'deleted' WHEN vec_id % 10 = 3 THEN 'incomplete' ELSE 'complete' END"
_ROUTE = "(SELECT *, user_id % 3 AS k FROM events)"
_NEAR = "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7), v AS (SELECT vec_id, label, list_distance(CAST(embedding AS DOUBLE[]), q) AS d FROM embeddings, q) "


def _values(rows: list[tuple], names: str) -> str:
    quoted = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) t({names})"


SQL = {
    "rec_all_in_one_page": _REC + "SELECT key, json FROM r", "q_eq_link": _ORDERS + " WHERE o_custkey = 42 AND o_orderstatus = 'F'", "q_ne_link": _ORDERS + " WHERE o_custkey <> 42 AND o_orderstatus = 'F'", "q_eq_set": "SELECT 'w' AS key",
    "q_order_mixed": """SELECT 'customer/' || c_custkey AS key FROM customer ORDER BY CASE c_custkey % 5 WHEN 4 THEN -1 ELSE c_custkey % 5 END, CASE WHEN c_custkey % 5 = 1 THEN c_custkey END, CASE WHEN c_custkey % 5 = 2 THEN c_name END, 'customer/' || c_custkey LIMIT 1000 OFFSET 200""",
    "trav_filter_id": "SELECT DISTINCT 'customer/' || o_custkey AS node, 1 AS depth FROM orders WHERE starts_with('customer/' || o_custkey, 'customer/1')", "trav_filter_link": "SELECT 'orders/' || o_orderkey AS node, 0 AS depth FROM orders WHERE o_custkey = 42",
    "trav_filter_dotted": "SELECT 'orders/' || o_orderkey AS node, 0 AS depth FROM orders WHERE o_custkey = 7 AND o_orderstatus <> 'F'", "trav_filter_set": "SELECT 'world' AS node",
    "path_resolution": """WITH n AS (SELECT n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 3) SELECT 'world' AS path, 'node' AS outcome, 'world' AS value UNION ALL SELECT 'world.nations', 'set', 'world' UNION ALL SELECT 'nation/3', 'node', 'nation/3'
        UNION ALL SELECT 'nation/3.name', 'scalar', '"' || n_name || '"' FROM n UNION ALL SELECT 'nation/3.region', 'node', 'region/' || n_regionkey FROM n UNION ALL SELECT 'nation/3.region.name', 'scalar', '"' || r_name || '"' FROM n
        UNION ALL SELECT 'nation/3.none', 'absent', NULL UNION ALL SELECT 'nation/3.none.more', 'absent', NULL UNION ALL SELECT 'nation/3.name.first', 'TraversalIntoScalar', NULL UNION ALL SELECT 'world.nations.name', 'TraversalIntoSet', NULL""",
    "text_leaves": "SELECT p_partkey, 'name' AS path, p_name AS leaf FROM part UNION ALL SELECT p_partkey, 'made.brand', p_brand FROM part UNION ALL SELECT p_partkey, 'tags.0', p_type FROM part UNION ALL SELECT p_partkey, 'tags.1', p_brand FROM part",
    "text_leaves_selected": "SELECT p_partkey, 'made' AS path, p_brand AS leaf FROM part UNION ALL SELECT p_partkey, 'tags.1', p_brand FROM part", "text_records_source": _bm25(_PARTS, "ring economy", _BEST + "20"),
    "text_counts": """WITH c AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id * 1000 + turn) AS n FROM conversations) SELECT CAST(50 AS BIGINT) AS candidate_count, count(DISTINCT conv_id) AS searched_count, true AS truncated_candidates FROM c WHERE n <= 50
        UNION ALL SELECT count(*), count(DISTINCT conv_id), false FROM c""",
    "text_explain": "WITH top AS (" + _bm25(_MSG_ROWS, "the user", _BEST + "20") + "), h AS (" + _bm25(_MSG_ROWS, "the user", "", out="SELECT id, count(DISTINCT field) AS n FROM s GROUP BY id") + ") SELECT top.id, 'bm25 over ' || n || ' fields' AS explain FROM top JOIN h ON top.id = h.id",
    "text_index_stored": _bm25(_MSG_ROWS, "the user", ""), "text_collection": _bm25(_CHANGED, "the user", _BEST + "30"),
    "vec_assemble": f"SELECT vec_id AS id, {_STATE} AS state, CASE WHEN {_STATE} = 'complete' THEN round(list_sum(CAST(embedding AS DOUBLE[])), 4) END AS total FROM embeddings",
    "vec_stats": f"SELECT count(*) FILTER (WHERE {_STATE} = 'complete') AS vectors, count(*) FILTER (WHERE {_STATE} = 'deleted') AS deleted, count(*) FILTER (WHERE {_STATE} = 'incomplete') AS incomplete FROM embeddings",
    "vec_stored": _NEAR + "SELECT * FROM (SELECT 'allow_stale' AS policy, vec_id AS id, round(d, 6) AS distance FROM v WHERE vec_id % 2 = 0 ORDER BY d, vec_id LIMIT 10) UNION ALL SELECT * FROM (SELECT 'fallback_exact', vec_id, round(d, 6) FROM v ORDER BY d, vec_id LIMIT 10)",
    "vec_collection": _NEAR + "SELECT id, round(d, 6) AS distance FROM (SELECT CAST(vec_id AS VARCHAR) AS id, d FROM v WHERE label = 1 AND vec_id <> 7 UNION ALL SELECT 'new', 0.0) ORDER BY d, id LIMIT 10",
    "errors_observed": _values([
        ("limit below one", "InvalidSpec"), ("wrong dimension", "InvalidSpec"), ("not finite", "InvalidSpec"), ("unknown metric", "InvalidSpec"), ("put of a wrong dimension", "InvalidSpec"), ("unknown key of a spec", "InvalidSpec"),
        ("preselected candidates", "InvalidSpec"), ("unknown policy", "InvalidSpec"), ("path behind a scalar", "TraversalIntoScalar"), ("path behind a set", "TraversalIntoSet"), ("coordinated scope without authority", "StrictScopeUnavailable"),
        ("list of objects", "ArrayOfObjectsUnsupported"), ("bytes that aren't base64", "InvalidBinaryMarker"), ("precondition that fails", "TransactionConflict"), ("stale index", "StaleIndex"),
    ], "request, error"),
    "oplog_roundtrip": f"SELECT CAST(event_id AS VARCHAR) AS op_id, 'actor' || (user_id % 3) AS author, micros AS millis, 'set_field' AS kind, node, event_type AS field, 'scalar' AS value_kind, value FROM {_E}",
    "oplog_checkpoint": _FOLDED, "oplog_requeue": _values([("n", f"f{i}", str(i)) for i in range(6)], "node, field, value"), "fold_idempotent": _FOLDED, "fold_redelivered": _FOLDED,
    "tx_commit": f"""WITH u AS (SELECT min(user_id) AS u FROM events WHERE event_type = 'click'), s AS ({_FOLDED}) SELECT field, CAST(round(value + CASE field WHEN 'click' THEN 1000.0 ELSE 0 END, 6) AS VARCHAR) AS value, true AS failed FROM s, u WHERE node = 'user/' || u AND field <> 'view'
        UNION ALL SELECT 'name', '"x"', true""",
    "tx_proposals": _values([("state", "yes"), ("provisional", "yes"), ("provisional", "later")], "seen_in, field"),
    "script_run": f"SELECT 'count' AS field, count(*) AS value FROM ({_FOLDED}) WHERE field = 'purchase' AND value > 50",
    "redact_hook": "SELECT c_custkey, 'hidden' AS c_name, c_acctbal FROM customer WHERE NOT c_acctbal < 0",
    "chain_aliases": _values([("once", "1"), ("load", "1"), ("open", "deep"), ("back", "deep"), ("scan", "['x', 'y']"), ("map", "['x', 'y']"), ("absent", "True")], "name, value"),
    "str_names": "SELECT p_partkey, lower(hex(p_name)) AS hex, p_name AS back, p_type || '/' || p_brand AS path, regexp_replace(p_name || '! ' || p_brand, '[^A-Za-z0-9_-]+', '-', 'g') AS actor FROM part",
    "str_sort_key": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 200", "bin_floats": "SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings",
    "route_target": f"SELECT event_id FROM {_ROUTE} WHERE (k = 0 AND event_type = 'error') OR (k = 1 AND user_id % 10 = 4) OR (k = 2 AND event_type IN ('click', 'view'))", "route_forward": "SELECT event_id, event_id % 4 - 1 AS ttl, 'p0,me' AS seen_by FROM events WHERE event_id % 4 > 1",
    "route_recommend": "SELECT event_id, 50 + 10 * least(event_id % 12, 8) + 5 * least(user_id % 11, 8) AS score FROM events", "route_recipients": "SELECT event_id AS route_id, c_custkey AS session FROM events JOIN customer ON event_id % 5000 = c_custkey % 5000 WHERE c_custkey % 100 <> user_id",
    "route_app": "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND conv_id % 3 = 1",
    "route_underlays": "SELECT s_suppkey AS id, 't' || (s_nationkey % 4) AS transport, s_acctbal > 5000 AS direct, s_suppkey % 7 AS priority FROM supplier WHERE s_nationkey % 4 > 0 ORDER BY s_acctbal > 5000 DESC, s_nationkey % 4 = 2 DESC, s_suppkey % 7, s_suppkey LIMIT 20",
    "route_peers": "SELECT p_partkey AS peer, CASE WHEN p_brand = 'Brand#17' THEN 2 ELSE 1 END AS hint FROM part WHERE p_size % 5 = 1", "route_batches": "SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4 AS batch FROM events",
    "route_accepted": "SELECT CAST(event_id AS VARCHAR) AS op_id, 'actor' || (user_id % 3) AS author, 'user/' || user_id AS node FROM events WHERE user_id % 3 = 1 OR (user_id % 3 = 0 AND starts_with('user/' || user_id, 'user/1'))",
    "fanin_gather": """SELECT 'e/' || event_id AS key, CASE event_id % 10 WHEN 1 THEN 'b' ELSE 'a' END AS peer, CAST(NULL AS VARCHAR) AS error FROM events WHERE event_id % 10 IN (1, 2) UNION ALL SELECT '{"a": "e/2"}', 'c', 'unreachable'""",
    "watch_field": f"SELECT 'scalar' AS value_kind, value, 1 AS given, 1 AS given_same, 1 AS computed FROM ({_FOLDED}) WHERE node = 'user/1' AND field = 'click'",
    "watch_traverse": "WITH RECURSIVE w(u, d) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT u + 1, d + 1 FROM w WHERE d < 5 AND u IN (SELECT user_id FROM events)) SELECT 'user/' || u AS node, d AS depth FROM w WHERE d > 0 AND u IN (SELECT user_id FROM events)",
    "watch_record_page": """SELECT key, json FROM (SELECT 'u/' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, arg_max(props, ts) AS json, arg_max(event_type, ts) AS last FROM events GROUP BY user_id) WHERE last <> 'error' AND key > 'u/00000010' ORDER BY key LIMIT 50""",
    "watch_text": _bm25("SELECT conv_id || '/' || turn AS id, 'text' AS field, text FROM conversations", "the user", ""), "watch_vectors": _NEAR + "SELECT CAST(vec_id AS VARCHAR) AS id, round(d, 6) AS distance FROM v WHERE vec_id % 2 = 1 ORDER BY d, CAST(vec_id AS VARCHAR) LIMIT 10",
    "watch_newest": f"SELECT {_WAITING} AS waiting, '{_BATCHES - 2}' AS newest, {_BATCHES} AS computed",
}
