"""Queries over records, operation logs, peers, transactions, stores and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomspan.operators import fanin, fold, graph, records, routing, transactions
from loomspan.plans.data import ops, read, world
from loomspan.plans.data import records as event_records
from loomspan.sources import oplog, snapshots
from loomspan.sources.tables import shared_dir, written
from loomspan.streaming import watch


def _scan(spec):
    return lambda spark, sf_dir: records.scan(event_records(spark, sf_dir), spec).select("key", "json")


_PAGE = {"prefix": "events/", "cursor": "events/0000000100", "limit": 32}


def rec_cursor(spark, sf_dir):
    """The cursors behind a page forward, a page backward, an empty page and the last page."""
    rows = event_records(spark, sf_dir)
    specs = {"forward": _PAGE, "backward": _PAGE | {"reverse": True}, "empty": _PAGE | {"limit": 0}, "all": {"prefix": "events/", "limit": 1_000_000_000}}
    return spark.createDataFrame([(k, records.next_cursor(rows, s)) for k, s in specs.items()], "scan string, cursor string")


def rec_get(spark, sf_dir):
    return records.get(event_records(spark, sf_dir), "events/0000000077").select("key", "json")


def rec_multi_get(spark, sf_dir):
    return records.get_many(event_records(spark, sf_dir), ["events/0000000003", "none", "events/0000000001", "events/0000000003"]).select("ordinal", "key", "json")


def rec_batch_apply(spark, sf_dir):
    batch = {
        "preconditions": [{"kind": "exists", "key": "events/0000000001"}, {"kind": "absent", "key": "events/x"}],
        "mutations": [{"kind": "put", "key": "events/x", "value": '{"k": 1}'}, {"kind": "delete", "key": "events/0000000001"}, {"kind": "delete_range", "range": {"startAt": "events/0000000010", "endBefore": "events/0000000020"}}],
    }
    out, report = records.apply_batch(event_records(spark, sf_dir), batch)
    return out.select("key", "json", F.lit(report["deletes"]).alias("deletes"))


def rec_delete_range(spark, sf_dir):
    return records.delete_range(event_records(spark, sf_dir), {"startAfter": "events/0000000050", "endAt": "events/0000000500"}).select("key")


def rec_overlay(spark, sf_dir):
    """Errors deleted, purchases replaced."""
    events = read(spark, sf_dir, "events")
    key = F.concat(F.lit("events/"), F.lpad(F.col("event_id").cast("string"), 10, "0"))
    over = events.where("event_type IN ('error', 'purchase')").select(key.alias("key"), F.lit("json").alias("kind"), F.lit("{}").alias("json"), F.lit(None).cast("binary").alias("bytes"), (F.col("event_type") == "error").alias("deleted"))
    return records.overlay(event_records(spark, sf_dir), over).select("key", "json")


def fold_lww(spark, sf_dir):
    return fold.fold_fields(ops(spark, sf_dir)).select("node", "field", F.col("value").cast("double").alias("value"), F.col("version.millis").alias("micros"))


def _tombstoned(spark, sf_dir):
    """Each event sets its user's field `last`; errors delete it."""
    kind = F.when(F.col("field") == "error", "delete_field").otherwise("set_field")
    return ops(spark, sf_dir).withColumn("kind", kind).withColumn("field", F.lit("last"))


def fold_tombstone(spark, sf_dir):
    log = _tombstoned(spark, sf_dir)
    return fold.fold_fields(log).select("node", F.lit(True).alias("alive"), F.col("value").cast("double").alias("value")).unionByName(fold.tombstones(log).select("node", F.lit(False).alias("alive"), F.lit(None).cast("double").alias("value")))


def _sets(spark, sf_dir):
    """Events add their type to their user's set `kinds`; an error takes the member click away, a signup sets the set to its own."""
    log = ops(spark, sf_dir)
    kind = F.when(F.col("field") == "error", "remove_set_member").when(F.col("field") == "signup", "set_field").otherwise("add_set_member")
    member = F.when(F.col("field") == "error", F.lit("click")).when(F.col("field") != "signup", F.col("field"))
    base = F.when(F.col("field") == "signup", F.array(F.lit("signup"), F.lit("click")))
    return log.withColumns({"kind": kind, "member": member, "set_members": base, "value_kind": F.lit("set"), "value": F.lit(None).cast("string")}).withColumn("field", F.lit("kinds"))


def fold_set_members(spark, sf_dir):
    return fold.fold_members(_sets(spark, sf_dir)).select("node", "member")


def fold_compact(spark, sf_dir):
    log = ops(spark, sf_dir).withColumn("seq", F.col("op_id").cast("long"))
    return fold.compact(log).select("node", "field", "op_id", "seq")


def merge_states(spark, sf_dir):
    """Two replicas' states, each of its half of the log, merged."""
    log = ops(spark, sf_dir)
    own = log.where("author = 'actor0'")
    rest = log.where("author <> 'actor0'")
    return fold.merge_fields(fold.fold_fields(own), fold.fold_fields(rest)).select("node", "field", F.col("value").cast("double").alias("value"))


def merge_member_states(spark, sf_dir):
    log = _sets(spark, sf_dir).where("kind <> 'set_field'")
    said = log.groupBy("node", "field", "member", "author").agg(F.max_by("kind", fold.marker()).alias("kind"), F.max(fold.marker()).alias("version"))
    state = said.select("node", "field", "member", "author", "version", (F.col("kind") == "add_set_member").alias("present"))
    out = fold.merge_members(state.where("author = 'actor0'").drop("author"), state.where("author <> 'actor0'").drop("author"))
    return out.where("present").select("node", "member")


def fold_authority(spark, sf_dir):
    policies = spark.createDataFrame([("user", "eventual", None), ("user/1", "coordinated", "actor1"), ("user/2", "coordinated", "actor0")], "scope string, mode string, authority string")
    return fold.authorised(ops(spark, sf_dir), policies).groupBy("node").agg(F.count("*").alias("n"))


def revisions(spark, sf_dir):
    return fold.revision(ops(spark, sf_dir)).select("node", F.col("version.millis").alias("micros"), F.col("version.op_id").alias("op_id"))


def _peers(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(F.concat(F.lit("e/"), F.col("event_id")).alias("key"), "event_type", "value")
    rounded = events.where("event_type IN ('click', 'purchase')").withColumn("value", F.floor("value").cast("double"))
    return fanin.union({"peer-b": events, "peer-a": rounded})


def fanin_records(spark, sf_dir):
    return fanin.merge_records(_peers(spark, sf_dir)).select("key", "event_type", "value", "peer", "versions")


def fanin_conflicts(spark, sf_dir):
    return fanin.conflicts(_peers(spark, sf_dir)).select("key", "winner", "versions", F.array_join("peers", ",").alias("peers"))


def tx_increment(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return transactions.increment(c, "c_acctbal", 10.5, F.col("c_mktsegment") == "HOUSEHOLD").select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


def tx_preconditions(spark, sf_dir):
    """What orders presume of their customers, checked against the customers of one segment."""
    state = read(spark, sf_dir, "customer").where("c_mktsegment = 'HOUSEHOLD'").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("string").alias("value"))
    kind = F.when(F.col("o_orderstatus") == "F", "exists").when(F.col("o_orderstatus") == "O", "absent").otherwise("value")
    wanted = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), kind.alias("kind"), F.lit("7").alias("expected"))
    return transactions.preconditions(wanted, state).select("o_orderkey", "ok")


def stats_graph(spark, sf_dir):
    return world(spark, sf_dir).stats()


def _stream_source(spark, sf_dir):
    """Events as operations in files that a stream reads."""
    log = written(ops(spark, sf_dir), "stream")
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    oplog.append(log, path)
    return oplog.stream(spark, path)


def _watched(spark, sf_dir, *watches):
    base = f"{shared_dir(spark)}/watch-{uuid.uuid4().hex}"
    watcher = watch.Watcher(spark, f"{base}/log", list(watches))
    watcher.run(_stream_source(spark, sf_dir), f"{base}/checkpoint").awaitTermination()
    return watcher


def watch_records(spark, sf_dir):
    """The last result of a live query over the folded log: purchases by user."""
    live = watch.state_watch("purchases", lambda fields, _: fields.where("field = 'purchase'").select("node", "value"), F.col("field") == "purchase")
    rows = _watched(spark, sf_dir, live).watches[0].results[-1]
    return spark.createDataFrame([(r["node"], float(r["value"])) for r in rows], "node string, value double")


def watch_changes(spark, sf_dir):
    """All change events of a stream, merged."""
    watcher = _watched(spark, sf_dir)
    events = spark.createDataFrame(list(watcher.events))
    out = watch.merged_events(events)
    return out.select(F.col("revision.millis").alias("micros"), "pending_ops", F.size("touched_paths").cast("long").alias("paths"), "data_changed")


def export_graph_json(spark, sf_dir):
    return snapshots.export_graph_json(world(spark, sf_dir)).where(F.col("node").startswith("nation/"))


def import_graph_json(spark, sf_dir):
    """Exported and read back: links and sets as they were."""
    back = snapshots.import_graph_json(snapshots.export_graph_json(world(spark, sf_dir)))
    return back.edges()


def snapshot_roundtrip(spark, sf_dir):
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    snapshots.save(world(spark, sf_dir), path)
    return snapshots.load(spark, path).fields


def vacuum_report(spark, sf_dir):
    """What the nations of one region don't reach."""
    g = world(spark, sf_dir)
    roots = g.fields.where("kind = 'link' AND value = 'region/1'").select("node")
    kept, gone = snapshots.vacuum(g, roots)
    return gone.select(F.col("nodes").alias("gone_nodes"), F.col("fields").alias("gone_fields")).crossJoin(kept.nodes.agg(F.count("*").alias("kept_nodes")))


def blob_liveness(spark, sf_dir):
    """Events' properties as blobs, of which purchases refer to theirs."""
    events = read(spark, sf_dir, "events").withColumn("id", F.sha2("props", 256))
    store = events.select("id", F.length("props").cast("long").alias("bytes"), F.col("props").cast("binary").alias("data")).dropDuplicates(["id"])
    fields = events.where("event_type = 'purchase'").select(F.concat(F.lit("e/"), "event_id").alias("node"), F.lit("file").alias("field"), F.lit("blob").alias("kind"), F.to_json(F.struct("id", F.length("props").alias("bytes"))).alias("value"))
    kept, garbage = snapshots.live_blobs(store, graph.Graph(fields, spark.createDataFrame([], graph.MEMBERS)))
    return kept.select("id", F.lit(True).alias("live")).unionByName(garbage.select("id", F.lit(False).alias("live")))


def presence(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("peer"), F.when(F.col("event_type") == "error", "offline").otherwise(F.col("event_type")).alias("state"), F.unix_micros(F.col("ts").cast("timestamp")).alias("millis"))
    return routing.presence(events)


def stream_assemble(spark, sf_dir):
    """Conversations as streams of chunks."""
    c = read(spark, sf_dir, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("end"))
    chunks = c.join(last, "conv_id").select(F.col("conv_id").alias("stream"), (F.col("turn") + 1).alias("seq"), F.col("text").alias("chunk"), (F.col("turn") == F.col("end")).alias("final"), F.col("turn").alias("ordinal"))
    return routing.assembled(chunks).select("stream", F.sha2("payload", 256).alias("payload_sha256"))


def route_dedup(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    routes = events.select(F.col("event_id").alias("route_id"), F.col("user_id").alias("sender"), F.col("event_type").alias("reply_to"), F.floor("value").alias("content_hash"), F.col("event_id").alias("ordinal"), F.array(F.lit("p")).alias("seen_by"))
    return routing.deduplicated(routes, "q").select("sender", "reply_to", "content_hash", "route_id")


QUERIES = {
    "rec_prefix": _scan({"prefix": "events/00000000"}), "rec_range": _scan({"startAt": "events/0000000100", "endBefore": "events/0000000200"}), "rec_range_open": _scan({"startAfter": "events/0000000100", "endAt": "events/0000000200", "reverse": True}),
    "rec_full": _scan({"prefix": "events/"}), "rec_page_fwd": _scan(_PAGE), "rec_page_rev": _scan(_PAGE | {"reverse": True}), "rec_cursor": rec_cursor, "rec_get": rec_get, "rec_multi_get": rec_multi_get,
    "rec_batch_apply": rec_batch_apply, "rec_delete_range": rec_delete_range, "rec_overlay": rec_overlay, "fold_lww": fold_lww, "fold_tombstone": fold_tombstone, "fold_set_members": fold_set_members,
    "fold_compact": fold_compact, "merge_states": merge_states, "merge_member_states": merge_member_states, "fold_authority": fold_authority, "revisions": revisions, "fanin_records": fanin_records, "fanin_conflicts": fanin_conflicts,
    "tx_increment": tx_increment, "tx_preconditions": tx_preconditions, "stats_graph": stats_graph, "watch_records": watch_records, "watch_changes": watch_changes, "export_graph_json": export_graph_json,
    "import_graph_json": import_graph_json, "snapshot_roundtrip": snapshot_roundtrip, "vacuum_report": vacuum_report, "blob_liveness": blob_liveness, "presence": presence, "stream_assemble": stream_assemble, "route_dedup": route_dedup,
}

_REC = "WITH r AS (SELECT 'events/' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS key, props AS json, event_type FROM events) "
_E = "(SELECT *, epoch_us(ts) AS micros, 'user/' || user_id AS node FROM events)"
_SETS = f"""WITH e AS (SELECT * FROM {_E}), base AS (SELECT node, max(micros) AS since FROM e WHERE event_type = 'signup' GROUP BY node),
    told AS (SELECT node, CASE WHEN event_type = 'error' THEN 'click' ELSE event_type END AS member, event_type <> 'error' AS present, micros FROM e WHERE event_type <> 'signup'
             UNION ALL SELECT node, unnest(['signup', 'click']), true, since FROM base)
    SELECT node, member FROM (SELECT t.node, t.member, arg_max(t.present, t.micros) AS present FROM told t LEFT JOIN base b ON t.node = b.node WHERE b.since IS NULL OR t.micros >= b.since GROUP BY t.node, t.member) WHERE present"""
_PEERS = """WITH a AS (SELECT 'e/' || event_id AS key, event_type, value, 'peer-b' AS peer FROM events UNION ALL
    SELECT 'e/' || event_id, event_type, CAST(floor(value) AS DOUBLE), 'peer-a' FROM events WHERE event_type IN ('click', 'purchase')) """

SQL = {
    "rec_prefix": _REC + "SELECT key, json FROM r WHERE starts_with(key, 'events/00000000')", "rec_range": _REC + "SELECT key, json FROM r WHERE key >= 'events/0000000100' AND key < 'events/0000000200'",
    "rec_range_open": _REC + "SELECT key, json FROM r WHERE key > 'events/0000000100' AND key <= 'events/0000000200'", "rec_full": _REC + "SELECT key, json FROM r",
    "rec_page_fwd": _REC + "SELECT key, json FROM r WHERE key > 'events/0000000100' ORDER BY key LIMIT 32", "rec_page_rev": _REC + "SELECT key, json FROM r WHERE key < 'events/0000000100' ORDER BY key DESC LIMIT 32",
    "rec_cursor": _REC + """SELECT 'forward' AS scan, (SELECT key FROM r WHERE key > 'events/0000000100' ORDER BY key LIMIT 1 OFFSET 31) AS cursor UNION ALL SELECT 'backward', (SELECT key FROM r WHERE key < 'events/0000000100' ORDER BY key DESC LIMIT 1 OFFSET 31)
        UNION ALL SELECT 'empty', (SELECT min(key) FROM r WHERE key > 'events/0000000100') UNION ALL SELECT 'all', NULL""",
    "rec_get": _REC + "SELECT key, json FROM r WHERE key = 'events/0000000077'",
    "rec_multi_get": _REC + "SELECT CAST(o AS INTEGER) AS ordinal, k AS key, json FROM (VALUES (0, 'events/0000000003'), (1, 'none'), (2, 'events/0000000001'), (3, 'events/0000000003')) v(o, k) LEFT JOIN r ON r.key = v.k",
    "rec_batch_apply": _REC + """SELECT key, json, 11 AS deletes FROM r WHERE key <> 'events/0000000001' AND NOT (key >= 'events/0000000010' AND key < 'events/0000000020') UNION ALL SELECT 'events/x', '{"k": 1}', 11""",
    "rec_delete_range": _REC + "SELECT key FROM r WHERE NOT (key > 'events/0000000050' AND key <= 'events/0000000500')",
    "rec_overlay": _REC + "SELECT key, CASE WHEN event_type = 'purchase' THEN '{}' ELSE json END AS json FROM r WHERE event_type <> 'error'",
    "fold_lww": f"SELECT node, event_type AS field, arg_max(value, micros) AS value, max(micros) AS micros FROM {_E} GROUP BY node, event_type",
    "fold_tombstone": f"SELECT node, arg_max(event_type, micros) <> 'error' AS alive, CASE WHEN arg_max(event_type, micros) <> 'error' THEN arg_max(value, micros) END AS value FROM {_E} GROUP BY node",
    "fold_set_members": _SETS,
    "fold_compact": f"SELECT node, event_type AS field, CAST(arg_max(event_id, micros) AS VARCHAR) AS op_id, min(event_id) AS seq FROM {_E} GROUP BY node, event_type",
    "merge_states": f"SELECT node, event_type AS field, arg_max(value, micros) AS value FROM {_E} GROUP BY node, event_type",
    "merge_member_states": f"""SELECT node, member FROM (SELECT node, CASE WHEN event_type = 'error' THEN 'click' ELSE event_type END AS member, arg_max(event_type <> 'error', micros) AS present FROM {_E} WHERE event_type <> 'signup' GROUP BY 1, 2) WHERE present""",
    "fold_authority": f"SELECT node, count(*) AS n FROM {_E} WHERE (node <> 'user/1' OR user_id % 3 = 1) AND (node <> 'user/2' OR user_id % 3 = 0) GROUP BY node",
    "revisions": f"SELECT node, max(micros) AS micros, CAST(arg_max(event_id, micros) AS VARCHAR) AS op_id FROM {_E} GROUP BY node",
    "fanin_records": _PEERS + "SELECT key, arg_min(event_type, peer) AS event_type, arg_min(value, peer) AS value, min(peer) AS peer, count(DISTINCT value) AS versions FROM a GROUP BY key",
    "fanin_conflicts": _PEERS + "SELECT key, min(peer) AS winner, count(DISTINCT value) AS versions, 'peer-a,peer-b' AS peers FROM a GROUP BY key HAVING count(DISTINCT value) > 1",
    "tx_increment": "SELECT c_custkey, round(CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN coalesce(c_acctbal, 0) + 10.5 ELSE c_acctbal END, 6) AS c_acctbal FROM customer",
    "tx_preconditions": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN c_custkey IS NOT NULL WHEN o_orderstatus = 'O' THEN c_custkey IS NULL ELSE coalesce(c_nationkey = 7, false) END AS ok
        FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'HOUSEHOLD') ON o_custkey = c_custkey""",
    "stats_graph": """SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + 1 AS nodes, 3 * (SELECT count(*) FROM nation) + 2 * (SELECT count(*) FROM region) AS fields, (SELECT count(*) FROM nation) AS links,
        (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS members, CAST(2 AS BIGINT) AS sets""",
    "watch_records": f"SELECT node, arg_max(value, micros) AS value FROM {_E} WHERE event_type = 'purchase' GROUP BY node",
    "watch_changes": f"SELECT max(micros) AS micros, count(*) AS pending_ops, count(DISTINCT node || '.' || event_type) AS paths, true AS data_changed FROM {_E}",
    "export_graph_json": """SELECT 'nation/' || n_nationkey AS node, '{"_":{"#":"nation/' || n_nationkey || '"},"name":"' || n_name || '","rank":' || n_nationkey || ',"region":{"#":"region/' || n_regionkey || '"}}' AS json FROM nation""",
    "import_graph_json": """SELECT 'nation/' || n_nationkey AS source, 'region' AS field, 'region/' || n_regionkey AS target, 'link' AS kind FROM nation UNION ALL
        SELECT 'world', 'nations', 'nation/' || n_nationkey, 'member' FROM nation UNION ALL SELECT 'world', 'regions', 'region/' || r_regionkey, 'member' FROM region""",
    "snapshot_roundtrip": """SELECT 'nation/' || n_nationkey AS node, 'name' AS field, 'scalar' AS kind, '"' || n_name || '"' AS value FROM nation UNION ALL SELECT 'nation/' || n_nationkey, 'rank', 'scalar', CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL
        SELECT 'nation/' || n_nationkey, 'region', 'link', 'region/' || n_regionkey FROM nation UNION ALL SELECT 'region/' || r_regionkey, 'name', 'scalar', '"' || r_name || '"' FROM region UNION ALL
        SELECT 'region/' || r_regionkey, 'rank', 'scalar', CAST(r_regionkey AS VARCHAR) FROM region""",
    "vacuum_report": """SELECT n_all - n_in + r_all - 1 + 1 AS gone_nodes, 3 * (n_all - n_in) + 2 * (r_all - 1) AS gone_fields, n_in + 1 AS kept_nodes FROM (SELECT count(*) AS n_all, count(*) FILTER (WHERE n_regionkey = 1) AS n_in FROM nation), (SELECT count(*) AS r_all FROM region)""",
    "blob_liveness": "SELECT sha256(props) AS id, bool_or(event_type = 'purchase') AS live FROM events GROUP BY 1",
    "presence": "SELECT user_id AS peer, arg_max(event_type, ts) AS state, max(epoch_us(ts)) AS millis FROM events GROUP BY user_id HAVING arg_max(event_type, ts) <> 'error'",
    "stream_assemble": "SELECT conv_id AS stream, sha256(string_agg(text, '' ORDER BY turn)) AS payload_sha256 FROM conversations GROUP BY conv_id",
    "route_dedup": "SELECT user_id AS sender, event_type AS reply_to, CAST(floor(value) AS BIGINT) AS content_hash, min(event_id) AS route_id FROM events GROUP BY 1, 2, 3",
}
