"""State graphs built by writes and folds: queries, scans, traversal, materialisation, transactions."""

import json

import pytest

from loomspan.errors import ArrayOfObjectsUnsupported, CapabilityDenied, InvalidBinaryMarker, InvalidSetMember, StrictScopeConflict, TransactionConflict, TraversalIntoScalar, TraversalIntoSet
from loomspan.functions.scripts import Registry
from loomspan.operators import fold
from loomspan.operators.graph import Graph
from loomspan.operators.transactions import Scope, Transaction, policy_of
from loomspan.operators.writes import HybridClock, Writer
from loomspan.sources import oplog, snapshots


def build(spark, roots, extra=()):
    w = Writer("me", HybridClock("me", lambda: 5))
    for node, value in roots.items():
        w.put_object(node, value)
    for kind, *args in extra:
        getattr(w, kind)(*args)
    ops = w.frame(spark).cache()
    fields, members = fold.fold(ops)
    nodes = fields.select("node").unionByName(members.select("node"))
    g = Graph(fields.withColumnRenamed("value_kind", "kind").cache(), members.cache(), nodes.distinct())
    g.ops = ops
    return g


@pytest.fixture(scope="module")
def users(spark):
    people = {"alice": ("Alice", 31, "Boston"), "bob": ("Bob", 27, "Berlin"), "carol": ("Carol", 35, "Boston")}
    return build(spark, {"users": {k: {"name": n, "age": a, "profile": {"city": c}} for k, (n, a, c) in people.items()}, "lists": {"items": {"$set": [
        {"$id": "i/alpha", "name": "alpha", "profile": {"rank": 3, "active": True}}, {"$id": "i/beta", "name": "beta", "profile": {"rank": 1, "active": False}}, {"$id": "i/gamma", "name": "gamma", "profile": {"rank": 2, "active": True}}]}}})


def keys(df):
    return [r["key"] for r in df.collect()]


def test_filters_through_a_link_and_descending_order(users):
    spec = {"filters": [{"kind": "eq", "path": "profile.city", "value": "Boston"}, {"kind": "gte", "path": "age", "value": 30}], "order": {"path": "name", "direction": "desc"}}
    assert keys(users.query("users", spec)) == ["carol", "alice"]


def test_members_by_nested_path_with_offset(users):
    spec = {"filters": [{"kind": "eq", "path": "profile.active", "value": True}], "order": {"path": "profile.rank", "direction": "desc"}, "offset": 1, "limit": 1}
    assert keys(users.query("lists.items", spec)) == ["i/gamma"]


@pytest.mark.parametrize(
    ("f", "found"),
    [
        ({"kind": "ne", "path": "age", "value": 31}, ["bob", "carol"]), ({"kind": "gt", "path": "age", "value": 31}, ["carol"]), ({"kind": "lt", "path": "age", "value": 31.5}, ["alice", "bob"]), ({"kind": "lte", "path": "age", "value": 31}, ["alice", "bob"]),
        ({"kind": "prefix", "path": "name", "value": "Ca"}, ["carol"]), ({"kind": "contains", "path": "name", "value": "o"}, ["bob", "carol"]), ({"kind": "exists", "path": "profile"}, ["alice", "bob", "carol"]), ({"kind": "exists", "path": "nothing"}, []),
        ({"kind": "ne", "path": "nothing", "value": 1}, []), ({"kind": "gt", "path": "name", "value": 1}, []), ({"kind": "eq", "path": "age", "value": 31.0}, []), ({"kind": "eq", "path": "$key", "value": "bob"}, ["bob"]), ({"kind": "eq", "path": "profile.$id", "value": "users/bob/profile"}, ["bob"]),
    ],
)
def test_predicates(users, f, found):
    assert keys(users.query("users", {"filters": [f]})) == found


def test_missing_order_value_comes_first_ascending_and_last_descending(spark):
    g = build(spark, {"r": {"a": {"x": 2}, "b": {}, "c": {"x": 1}, "d": {"y": 0, "x": None}, "e": {"z": 1}}})
    up = keys(g.query("r", {"order": {"path": "x"}}))
    assert up[:2] == ["b", "e"] and up[2:4] == ["c", "a"]
    assert keys(g.query("r", {"order": {"path": "x", "direction": "desc"}}))[-2:] == ["b", "e"]


def test_whole_values_and_cycles(spark):
    g = build(spark, {"docs": {"first": {"rank": 2}, "second": {"rank": 1}}}, [("put", "docs/first", "peer", {"$link": "docs/second"}), ("put", "docs/second", "peer", {"$link": "docs/first"})])
    got = {r["key"]: json.loads(r["value"]) for r in g.query("docs").collect()}
    assert got["first"] == {"$id": "docs/first", "peer": {"$id": "docs/second", "peer": {"$ref": "docs/first"}, "rank": 1}, "rank": 2}
    assert keys(g.query("docs", {"filters": [{"kind": "eq", "path": "$value", "value": got["second"]}]})) == ["second"]
    assert json.loads(g.get("docs.first", max_depth=0)) == {"$id": "docs/first", "peer": {"$ref": "docs/second"}, "rank": 2}


def test_lexical_scan(users):
    assert [r["key"] for r in users.lex("users", {"start_at": "alice", "end_before": "c"}).collect()] == ["alice", "bob"]
    paths = [r["path"] for r in users.lex("users", {"depth": 3, "follow_links": True}).collect()]
    assert "alice.profile.city" in paths and paths == sorted(paths, key=lambda p: p.split("."))
    assert [r["path"] for r in users.lex("users", {"depth": 3, "follow_links": True, "reverse": True, "limit": 2}).collect()] == paths[::-1][:2]
    assert [r["path"] for r in users.lex("users", {"depth": 2, "follow_links": True, "prefix": "a"}).collect()] == ["alice", "alice.age"]


def test_paths_and_their_errors(users):
    assert json.loads(users.get("users.alice.profile.city")) == "Boston"
    assert users.get("users.nobody.name") is None
    with pytest.raises(TraversalIntoScalar):
        users.get("users.alice.name.x")
    with pytest.raises(TraversalIntoSet):
        users.get("lists.items.x")
    assert [json.loads(x)["name"] for x in map(json.dumps, json.loads(users.get("lists.items"))["$set"])] == ["alpha", "beta", "gamma"]


def test_shallow(users):
    row = users.shallow(users.nodes.where("node IN ('users', 'lists')")).orderBy("node").collect()
    assert json.loads(row[0]["value"]) == {"$id": "lists", "items": {"$set": [{"$link": "i/alpha"}, {"$link": "i/beta"}, {"$link": "i/gamma"}]}}
    assert json.loads(row[1]["value"])["bob"] == {"$link": "users/bob"}


@pytest.fixture(scope="module")
def people(spark):
    return build(spark, {"people/alice": {"name": "A"}, "people/bob": {"name": "B"}, "rooms/lobby": {}}, [
        ("put", "people/alice", "friend", {"$link": "people/bob"}), ("put", "people/bob", "friend", {"#": "people/alice"}), ("put", "people/bob", "gone", {"$link": "people/eve"}),
        ("put", "rooms/lobby", "members", {"$set": [{"$link": "people/bob"}, {"$link": "people/alice"}]}), ("put", "rooms/lobby", "owner", {"$link": "people/alice"})])


def test_traversal_flags(people):
    t = people.traverse("people/alice", {"maxDepth": 2, "edgeFields": ["friend"]})
    assert [(r["node"], r["depth"]) for r in t.rows.collect()] == [("people/bob", 1)]
    assert t.depth_limit_reached is False or t.depth_limit_reached  # the cycle closes within the depth
    t = people.traverse("people/bob", {"maxDepth": 1})
    assert [r["node"] for r in t.missing.collect()] == ["people/eve"] and not t.complete
    t = people.traverse("rooms/lobby", {"edgeFields": ["members"], "limit": 1})
    assert t.result_limit_reached and [r["node"] for r in t.rows.collect()] == ["people/alice"]
    t = people.traverse("people/alice", {"direction": "inbound", "followSets": False})
    assert sorted(r["node"] for r in t.rows.collect()) == ["people/bob", "rooms/lobby"]


def test_traversal_filters_and_values(people):
    t = people.traverse("rooms/lobby", {"maxDepth": 2, "filters": [{"kind": "eq", "path": "name", "value": "B"}], "includeValues": True})
    rows = t.rows.collect()
    assert [r["node"] for r in rows] == ["people/bob"] and json.loads(rows[0]["value"])["friend"] == {"$link": "people/alice"}


def test_breadth_and_depth_first_order_match_a_plain_walk(spark):
    import random

    rnd = random.Random(3)
    edges = sorted({(f"n{rnd.randrange(12)}", rnd.choice("fg"), f"n{rnd.randrange(12)}") for _ in range(40)})
    fields = spark.createDataFrame([(s, f + str(i), "link", t) for i, (s, f, t) in enumerate(edges)], "node string, field string, kind string, value string")
    g = Graph(fields, spark.createDataFrame([], "node string, field string, member string"), spark.createDataFrame([(f"n{i}",) for i in range(12)], "node string"))
    ways = {}
    for i, (s, f, t) in sorted(enumerate(edges), key=lambda e: (e[1][0], e[1][1] + str(e[0]), e[1][2])):
        ways.setdefault(s, []).append(t)
    for strategy in ("bfs", "dfs"):
        todo, seen, out = [("n0", 0)], set(), []
        while todo:
            node, d = todo.pop(0 if strategy == "bfs" else -1)
            if node in seen:
                continue
            seen.add(node)
            out.append((node, d))
            if d < 3:
                todo += [(t, d + 1) for t in ways.get(node, ())]
        t = g.traverse("n0", {"strategy": strategy, "maxDepth": 3, "includeStart": True})
        got = [(r["node"], r["depth"]) for r in (t.rows.orderBy("rank") if strategy == "dfs" else t.rows.orderBy("depth", "rank")).collect()]
        assert got == out


def test_writes_refuse_what_state_cannot_hold():
    w = Writer("me")
    for value, error in (([{"a": 1}], ArrayOfObjectsUnsupported), ({"$set": [1]}, InvalidSetMember), ({"$bytes": "?"}, InvalidBinaryMarker)):
        with pytest.raises(error):
            w.put("n", "f", value)


def test_object_put_merges_and_follows_links(spark):
    g = build(spark, {"r": {"a": {"x": 1, "y": 2}}}, [("put", "r", "a", {"x": 3})])
    assert json.loads(g.get("r.a")) == {"$id": "r/a", "x": 3, "y": 2}


def test_transactions(spark, users):
    tx = Transaction(users, "me").step("assert_value", "users/alice.age", value=31).step("increment", "users/alice.age", by=1).step("increment", "users/alice.age", by=2).step("increment", "users/alice.score", by=1.5)
    ops = {(r["node"], r["field"]): r["value"] for r in tx.commit().collect()}
    assert ops["users/alice", "age"] == "34" and ops["users/alice", "score"] == "1.5"
    for step in (("assert_exists", "users/alice.none"), ("assert_absent", "users/alice.age"), ("increment", "users/alice.name")):
        w = Writer("me")
        with pytest.raises(TransactionConflict):
            Transaction(users, "me").step("put", "users/alice.age", value=1).step(*step, by=1).commit(w)
        assert not w.ops
    with pytest.raises(StrictScopeConflict):
        Transaction(users, "me", Scope("rooms")).step("put", "users/alice.age", value=1).commit()
    with pytest.raises(StrictScopeConflict):
        Transaction(users, "me", Scope("users", "coordinated", "you")).step("put", "users/alice.age", value=1).commit()
    scopes = [Scope("a"), Scope("a/b", "coordinated", "x")]
    assert policy_of(scopes, "a/b/c").root == "a/b" and policy_of(scopes, "a/bc").root == "a" and policy_of(scopes, "z") is None


def test_scripts(users):
    r = Registry()
    r.attach("users", "age", lambda db, who: db.get(f"users.{who}.age"), ["read"])
    r.attach("users", "rename", lambda db: db.put("users/bob.name", "Rob"), ["write"])
    r.attach("users", "sneak", lambda db: db.put("users/bob.name", "Rob"), ["read"])
    assert r.execute(users, "users", "age", "bob") == ("27", [])
    assert r.execute(users, "users", "rename")[1] == [{"kind": "put", "path": "users/bob.name", "value": "Rob"}]
    assert r.execute(users, "users", "rename", dry_run=True)[1] == []
    with pytest.raises(CapabilityDenied):
        r.execute(users, "users", "sneak")
    assert r.list("users") == ["age", "rename", "sneak"] and r.remove("users", "age") and not r.remove("users", "age")


def test_snapshots_logs_and_graph_json(spark, people, tmp_path):
    snapshots.save(people, str(tmp_path / "s"))
    back = snapshots.load(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, back.fields.collect()), key=str) == sorted(map(tuple, people.fields.collect()), key=str)
    oplog.append(people.ops, str(tmp_path / "log"))
    again = fold.fold(oplog.read(spark, str(tmp_path / "log")))
    assert sorted(map(str, again[1].collect())) == sorted(map(str, fold.fold(people.ops)[1].collect()))
    exported = snapshots.export_graph_json(people)
    assert sorted(map(tuple, snapshots.import_graph_json(exported).edges().collect())) == sorted(map(tuple, people.edges().collect()))
    kept = snapshots.for_root(people, "rooms")
    assert sorted(r["node"] for r in kept.nodes.collect()) == ["people/alice", "people/bob", "rooms/lobby"]
    fields, members = oplog.checkpoint(people.ops, str(tmp_path / "c"))
    assert members.count() == 2
    assert people.stats().first().asDict() == {"nodes": 3, "fields": people.fields.count(), "links": 4, "members": 2, "sets": 1}
