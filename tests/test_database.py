"""The handle on everything, and watches of each kind."""

import pytest
from pyspark.sql import functions as F

from loomspan.database import Database
from loomspan.errors import InvalidSpec, StrictScopeUnavailable, TransactionConflict
from loomspan.functions import strings
from loomspan.functions.scalar import canonical, typed
from loomspan.streaming import watch


def test_graph_and_replication(spark):
    a, b = Database(spark, "a"), Database(spark, "b")
    a.root("users").put({"alice": {"name": "Alice", "age": 31, "profile": {"city": "Boston"}}, "bob": {"name": "Bob", "age": 27}})
    a.root("users").field("alice").field("profile").field("city").put("Berlin")
    a.root("rooms").field("lobby").field("members").set({"$id": "people/x", "name": "X"}).set("people/y").remove("people/y")
    assert a.root("users").path("alice.profile.city").once() == "Berlin" and a.root("users").field("none").is_absent()
    assert [r["key"] for r in a.root("users").find().where_gte("age", 20).order_by("name", "desc").limit(1).run().collect()] == ["bob"]
    assert a.root("users").find().where_exists("profile").first().first()["key"] == "alice"
    b.apply_operations(a.drain_pending_operations())
    b.apply_operations(a.log())
    assert a.pending_operations().isEmpty() and b.log().count() == a.log().count()
    assert b.root("rooms").path("lobby.members").once() == {"$set": [{"$id": "people/x", "name": "X"}]}
    b.root("users").path("bob.age").unset()
    a.apply_operations(b.pending_operations())
    assert a.root("users").field("bob").once() == {"$id": "users/bob", "name": "Bob"} and a.root("users").field("bob").back().at == "users"
    tx = a.transaction().step("increment", "users/alice.age", by=1)
    a.commit(tx)
    assert a.root("users").path("alice.age").once() == 32
    a.scripts.attach("users", "age", lambda db: db.increment("users/alice.age", 8), ["transaction"])
    a.run_script("users", "age")
    assert a.root("users").path("alice.age").once() == 40
    with pytest.raises(StrictScopeUnavailable):
        a.configure_scope("rooms", "coordinated")
    a.configure_scope("users/alice", "coordinated", "a")
    assert a.policy("users/alice/profile").authority == "a" and a.policy("rooms") is None
    b.root("users").path("alice.name").put("Eve")
    a.apply_operations(b.pending_operations())
    assert a.root("users").path("alice.name").once() == "Alice"


def test_records_text_vectors(spark):
    db = Database(spark, "a")
    for i in range(5):
        db.put_record(f"k/{i}", {"title": f"secure mesh {i}" if i % 2 else "plain", "n": i})
    db.put_record("bin", data=b"\x01")
    db.delete_record("k/0")
    page, cursor = db.scan_records({"prefix": "k/", "limit": 2})
    assert [r["key"] for r in page.collect()] == ["k/1", "k/2"] and cursor == "k/2"
    assert db.apply_record_batch({"mutations": [{"kind": "delete_range", "range": {"startAt": "k/4"}}]}) == {"puts": 0, "deletes": 1, "range_deletes": 1}
    with pytest.raises(TransactionConflict):
        db.apply_record_batch({"preconditions": [{"kind": "exists", "key": "k/4"}]})
    assert [r["id"] for r in db.text_search({"kind": "records", "scan": {"prefix": "k/"}}, "secure", {"limit": 5}).collect()] == ["k/1", "k/3"]
    with pytest.raises(InvalidSpec):
        db.text_search({"kind": "records", "scan": {"limit": 1}}, "secure")
    db.create_text_collection("notes", fields={"title": 2.0, "body": 1.0})
    db.put_text_document("notes", "alpha", {"title": "secure mesh routing", "body": "trust routing proposal"}, kind="note")
    db.put_text_document("notes", "beta", {"body": "unrelated local note"})
    assert [r["id"] for r in db.text_search("notes", "secure routing").collect()] == ["alpha"] and db.text_index_stats("notes").first()["documents"] == 2
    assert db.delete_text_document("notes", "beta") and not db.delete_text_document("notes", "beta")
    db.root("users").put({"x": {"bio": "likes mesh"}, "y": {"bio": "else"}})
    assert [r["id"] for r in db.text_search({"kind": "query", "path": "users"}, "mesh").collect()] == ["x"]
    db.create_vector_collection("v", 1)
    for name, x in (("alpha", 1.0), ("beta", 1.0), ("far", 5.0)):
        db.put_vector("v", name, [x], tag="keep" if name != "far" else "drop")
    assert [r["id"] for r in db.search_vectors("v", [0.0], {"limit": 5, "filter": {"metadata": {"eq": {"tag": "keep"}}}}).collect()] == ["alpha", "beta"]
    assert db.delete_vector("v", "far") and tuple(db.vector_index_stats("v").first()) == (2, 1, 0)
    with pytest.raises(InvalidSpec):
        db.put_vector("v", "bad", [1.0, 2.0])


def test_watches_of_each_kind(spark, tmp_path):
    schema = "op_id string, seq long, millis long, counter long, actor string, node string, field string, key string, kind string, json string, bytes binary, deleted boolean"

    def row(i, key, text, deleted=False):
        return (f"o{i}", i, i, 0, "a", "n", "f", key, "json", text, None, deleted)

    for rows in ([row(1, "t/1", '{"x": "mesh"}'), row(2, "v/1", "[1.0]")], [row(3, "z/1", '"else"')], [row(4, "t/2", '{"x": "mesh mesh"}'), row(5, "v/1", None, True), row(6, "v/2", "[3.0]")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    watches = [watch.record_watch({"prefix": "t/"}), watch.text_watch("mesh", {"limit": 3}), watch.vector_watch([0.0], {"limit": 1})]
    w = watch.Watcher(spark, str(tmp_path / "log"), watches)
    w.run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
    assert [r["key"] for r in watches[0].results[-1]] == ["t/1", "t/2"] and len(watches[0].results) <= 3
    assert {r["id"] for r in watches[1].results[-1]} == {"t/1", "t/2"}
    assert watches[2].results[-1] == [{"id": "v/2", "distance": 3.0}]


def test_names_and_sort_keys(spark):
    values = [False, True, -1e300, -2.5, -1, 0, 3, 3.5, 1e9, "", "a", "b", "é", None]
    df = spark.createDataFrame([(i, canonical(v)) for i, v in enumerate(values)], "i int, raw string").withColumn("k", strings.sort_key(typed(F.col("raw"))))
    assert [r["i"] for r in df.orderBy("k").collect()] == list(range(len(values)))
    row = df.limit(1).select(strings.hex_component(F.lit("a/é")).alias("h"), strings.unhex_component(F.lit("612fc3a9")).alias("u"), strings.join_path(F.lit("a"), F.lit(""), F.lit("b")).alias("p"), strings.clean_actor(F.lit("a b!c")).alias("c")).first()
    assert tuple(row) == ("612fc3a9", "a/é", "a/b", "a-b-c")
    assert strings.bytes_to_floats(strings.floats_to_bytes([1.5, -2.0])) == [1.5, -2.0]
