"""Fan-in, routing relations, watches."""

from pyspark.sql import functions as F

from loomspan.operators import fanin, routing
from loomspan.operators.fold import OPS
from loomspan.sources import oplog
from loomspan.streaming import watch


def test_record_fan_in(spark):
    schema = "key string, value string"
    rows = fanin.union({"peer-b": spark.createDataFrame([("shared", "false")], schema), "peer-a": spark.createDataFrame([("shared", "true"), ("unique-a", "1")], schema)})
    got = {r["key"]: (r["value"], r["peer"], r["versions"]) for r in fanin.merge_records(rows).collect()}
    assert got == {"shared": ("true", "peer-a", 2), "unique-a": ("1", "peer-a", 1)}
    assert {r["key"]: r["value"] for r in fanin.winner_by_window(rows).collect()} == {"shared": "true", "unique-a": "1"}
    assert [(r["key"], r["winner"], r["peers"]) for r in fanin.conflicts(rows).collect()] == [("shared", "peer-a", ["peer-a", "peer-b"])]
    assert fanin.cursors({"a": "x", "b": None}) == '{"a": "x"}' and fanin.cursors({"b": None}) is None
    assert fanin.failures(spark, {"peer-c": "down"}).count() == 1


def test_text_fan_in(spark):
    schema = "id string, score double"
    rows = fanin.union({"a": spark.createDataFrame([("a", 2.0)], schema), "b": spark.createDataFrame([("b", 4.0), ("a", 2.0)], schema)})
    assert [(r["id"], r["peer"]) for r in fanin.merge_text(rows).collect()] == [("b", "b"), ("a", "a"), ("a", "b")]
    counts = spark.createDataFrame([(2, 2, False), (3, 1, True)], "candidate_count int, searched_count int, truncated_candidates boolean")
    assert tuple(fanin.merge_counts(counts).first()) == (5, 3, True, "peer_local")


def test_routing(spark):
    routes = spark.createDataFrame(
        [(1, "r1", "s", "x", "h", ["p"], 3, "peer", "me", "c", ""), (2, "r1", "s", "y", "h2", ["p"], 1, "broadcast", "", "c", ""), (3, "r2", "s", "x", "h", ["p"], 2, "topic", "t", "c", ""), (4, "r3", "q", "x", "h", ["me"], 2, "broadcast", "", "d", "")],
        "ordinal int, route_id string, sender string, reply_to string, content_hash string, seen_by array<string>, ttl int, target_kind string, target string, channel string, pad string",
    )
    assert [r["ordinal"] for r in routing.deduplicated(routes, "me").collect()] == [1]
    assert sorted(r["ordinal"] for r in routing.for_target(routes, "me", ["t"], "c").collect()) == [1, 2, 3]
    assert sorted((r["ordinal"], r["ttl"], r["seen_by"][-1]) for r in routing.forwarded(routes, "z").collect()) == [(1, 2, "z"), (3, 1, "z"), (4, 1, "z")]
    events = spark.createDataFrame([("p", "on", 1), ("p", "offline", 2), ("q", "on", 1)], "peer string, state string, millis long")
    assert [r["peer"] for r in routing.presence(events).collect()] == ["q"]
    chunks = spark.createDataFrame([("s", 2, "b", True, 0), ("s", 1, "a", False, 1), ("s", 1, "z", False, 2), ("t", 2, "b", True, 3)], "stream string, seq int, chunk string, final boolean, ordinal int")
    assert [tuple(r) for r in routing.assembled(chunks).collect()] == [("s", "ab")]
    peers = spark.createDataFrame([("a", ["text_collection:x"]), ("b", ["text_collection:y", "fast"]), ("c", [])], "peer string, capabilities array<string>")
    assert [r["peer"] for r in routing.chosen_peers(peers, collection="y").collect()] == ["b", "a", "c"]
    assert [r["peer"] for r in routing.chosen_peers(peers, capability="fast").collect()] == ["b"]
    assert peers.select(routing.recommendation(F.col("capabilities"), F.col("capabilities")).alias("s")).orderBy("s").first()["s"] == 50
    paths = spark.createDataFrame([("1", "ws", False, 1), ("2", "rtc", True, 9), ("3", "moq", False, 0), ("4", "x", True, 0)], "id string, transport string, direct boolean, priority int")
    assert [r["id"] for r in routing.underlays(paths, ["ws", "rtc", "moq"], "ws").collect()] == ["2", "1", "3"]
    sessions = spark.createDataFrame([("c", "s1", "s"), ("c", "s2", "t")], "channel string, session string, session_peer string")
    assert {r["session"] for r in routing.recipients(routes, sessions).collect()} == {"s2"}
    assert routing.batches(routes, "channel", 2).where("batch = 1").count() == 1
    assert routing.app_messages(routes, channel="d", target=None).count() == 1
    grants = spark.createDataFrame([("me", "a/")], "author string, prefix string")
    ops = spark.createDataFrame([("me", "a/1"), ("me", "b/1"), ("you", "a/1")], "author string, node string")
    assert routing.accepted(ops, grants).count() == 1


def test_watches_emit_only_changes(spark, tmp_path):
    def op(i, field, value):
        return (f"o{i}", "a", i, 0, "a", "set_field", "n", field, None, "scalar", value, None)

    for i, rows in enumerate(([op(1, "x", "1")], [op(2, "y", "5")], [op(3, "x", "1")], [op(4, "x", "2"), op(5, "x", "3")])):
        oplog.append(spark.createDataFrame(rows, OPS).coalesce(1), str(tmp_path / "ops"))
    one, same = watch.field_watch("n", "x"), watch.field_watch("n", "x")
    whole = watch.state_watch("all", lambda fields, _: fields.select("field", "value"))
    w = watch.Watcher(spark, str(tmp_path / "log"), [one, same, whole])
    w.run(oplog.stream(spark, str(tmp_path / "ops"), max_files=1), str(tmp_path / "cp")).awaitTermination()
    assert one.results == same.results and one.results[-1] == [{"value_kind": "scalar", "value": "3"}]
    assert {r["field"]: r["value"] for r in whole.results[-1]} == {"x": "3", "y": "5"}
    assert len(one.results) <= 3 and len(w.events) == 4
    merged = watch.merged_events(spark.createDataFrame(list(w.events))).first()
    assert merged["pending_ops"] == 5 and merged["touched_paths"] == ["n.x", "n.y"] and merged["revision"]["millis"] == 5
