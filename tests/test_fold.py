"""Operation logs: last writer wins, sets, tombstones, compaction, authority; compared with applying in marker order."""

import random

from loomspan.operators import fold
from loomspan.operators.fold import OPS


def op(i, millis, kind, node="n", field="f", member=None, value_kind=None, value=None, members=None, actor="a", author="a"):
    return (f"o{i}", author, millis, 0, actor, kind, node, field, member, value_kind, value, members)


def apply(ops):
    """One field after the other in marker order: its value, or its members, or nothing."""
    state = {}
    for o in sorted(ops, key=lambda o: (o[2], o[3], o[4], o[0])):
        slot = o[6], o[7]
        if o[5] == "set_field":
            state[slot] = set(o[11]) if o[9] == "set" else o[10]
        elif o[5] == "delete_field":
            state.pop(slot, None)
        else:
            if not isinstance(state.get(slot), set):
                state[slot] = set()
            (state[slot].add if o[5] == "add_set_member" else state[slot].discard)(o[8])
    return state


def test_random_logs(spark):
    rnd = random.Random(11)
    ops = []
    for case in range(60):
        for i in range(rnd.randrange(1, 9)):
            kind = rnd.choice(["set_field", "set_list", "delete_field", "add_set_member", "remove_set_member"])
            more = {"value_kind": "scalar", "value": str(i)} if kind == "set_field" else {"value_kind": "set", "members": rnd.sample(["x", "y", "z"], 2)} if kind == "set_list" else {"member": rnd.choice("xyz")} if "member" in kind else {}
            ops.append(op(f"{case}-{i}", rnd.randrange(6), "set_field" if kind == "set_list" else kind, node=f"n{case}", actor=rnd.choice("ab"), **more))
    rnd.shuffle(ops)
    fields, members = fold.fold(spark.createDataFrame(ops + ops[:20], OPS))
    got = {(r["node"], r["field"]): set() if r["value_kind"] == "set" else r["value"] for r in fields.collect()}
    for r in members.collect():
        got[r["node"], r["field"]].add(r["member"])
    assert got == apply(ops)


def test_pinned_rules(spark):
    ops = [
        op(1, 1, "set_field", field="a", value_kind="scalar", value="1"), op(2, 2, "set_field", field="a", value_kind="scalar", value="2"),
        op(3, 1, "add_set_member", field="s", member="x", actor="l"), op(4, 1, "add_set_member", field="s", member="y", actor="r"), op(5, 3, "remove_set_member", field="s", member="x"),
        op(6, 4, "set_field", field="d", value_kind="scalar", value="1"), op(7, 5, "delete_field", field="d"), op(8, 1, "remove_set_member", field="e", member="q"),
    ]
    log = spark.createDataFrame(ops, OPS)
    fields, members = fold.fold(log)
    assert {(r["field"], r["value_kind"], r["value"]) for r in fields.collect()} == {("a", "scalar", "2"), ("s", "set", None), ("e", "set", None)}
    assert [r["member"] for r in members.collect()] == ["y"]
    assert [r["field"] for r in fold.tombstones(log).collect()] == ["d"]
    assert fold.revision(log).first()["version"]["millis"] == 5
    from pyspark.sql import functions as F

    kept = fold.compact(log.withColumn("seq", F.substring("op_id", 2, 9).cast("long")))
    assert {(r["op_id"], r["seq"]) for r in kept.collect()} == {("o2", 1), ("o5", 3), ("o4", 4), ("o7", 6), ("o8", 8)}


def test_state_merge_and_authority(spark):
    ops = [op(i, i % 7, "set_field", node=f"n{i % 5}", value_kind="scalar", value=str(i), author="ab"[i % 2]) for i in range(40)]
    log = spark.createDataFrame(ops, OPS)
    halves = [fold.fold_fields(log.where(f"author = '{a}'")) for a in "ab"]
    whole = sorted(map(str, fold.fold_fields(log).collect()))
    assert sorted(map(str, fold.merge_fields(*halves).collect())) == whole
    assert sorted(map(str, fold.merge_fields(fold.fold_fields(log), fold.fold_fields(log)).collect())) == whole
    rules = spark.createDataFrame([("n1", "coordinated", "a"), ("n2", "eventual", None)], "scope string, mode string, authority string")
    assert fold.authorised(log, rules).count() == sum(1 for o in ops if o[6] != "n1" or o[1] == "a")
