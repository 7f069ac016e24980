"""Tool calls linked, ordered, validated and written."""

import json

from loomspan.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, id string, v int"


def test_calls(spark):
    calls = {"content": "ok", "tool_calls": [{"id": "b", "name": "add", "arguments": {"y": 2, "x": 1}, "depends_on": ["a"]}, {"id": "a", "name": "get", "arguments": '{"q": "z"}'}, {"id": "c", "name": "get", "arguments": {"q": 5, "w": 1}}]}
    more = {"tool_calls": [{"id": "p", "name": "get", "arguments": {"q": "1"}, "depends_on": ["q"]}, {"id": "q", "name": "nope", "arguments": [1], "depends_on": ["p"]}, {"name": "get", "arguments": {"q": "1"}}, {"id": "a", "name": "get", "arguments": {"q": "1"}, "depends_on": ["zz"]}]}
    rows = [
        (1, 0, "user", 'hi "there"\n'), (1, 1, "assistant", json.dumps(calls)), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "R"})), (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": "R"})),
        (1, 4, "assistant", json.dumps(more)), (2, 0, None, None), (2, 1, "assistant", "{not json"), (2, 2, "tool", "plain"), (2, 3, "user", json.dumps(calls)), (3, 0, "assistant", ""), (None, 0, "assistant", json.dumps(calls)), (2, 0, None, None),
    ]
    tools = spark.createDataFrame([("add", [("x", "integer", True), ("y", "number", True)]), ("get", [("q", "string", True)])], "name string, parameters array<struct<name string,type string,required boolean>>")
    messages = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = {}
    out = chat.format_chat(messages, tools).collect()
    assert len(out) == len(rows)
    for r in out:
        got[r["conv_id"], r["turn"]] = r
        assert json.dumps(json.loads(r["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["json"]
    made = json.loads(got[1, 1]["json"])["tool_calls"]
    assert [(c["id"], c["level"], c.get("result_turn")) for c in made] == [("a", 0, 2), ("c", 0, None), ("b", 1, None)]
    assert made[1]["errors"] == ["unknown argument w", "wrong type of q"] and made[2]["arguments"] == {"x": 1, "y": 2}
    assert (got[1, 1]["n_calls"], got[1, 1]["n_linked"], got[1, 1]["n_invalid"]) == (3, 1, 1)
    assert json.loads(got[1, 2]["json"]) == {"content": "R", "linked": True, "role": "tool", "tool_call_id": "a"} and json.loads(got[1, 3]["json"])["linked"] is False
    bad = {c.get("id"): c["errors"] for c in json.loads(got[1, 4]["json"])["tool_calls"]}
    assert bad == {"p": ["circular dependency"], "q": ["arguments are no object", "circular dependency", "unknown tool"], None: ["no id"], "a": ["repeated id", "unknown dependency"]}
    assert json.loads(got[2, 0]["json"]) == {} and json.loads(got[2, 1]["json"])["content"] == "{not json" and json.loads(got[2, 2]["json"]) == {"content": "plain", "role": "tool"}
    assert json.loads(got[2, 3]["json"])["content"] == json.dumps(calls) and json.loads(got[3, 0]["json"]) == {"content": "", "role": "assistant"}
    assert chat.format_chat(messages.limit(0)).collect() == []


def test_long_chains(spark):
    calls = [{"id": str(i), "name": "f", "arguments": {}, "depends_on": [str(i - 1)] if i else []} for i in range(6)]
    df = spark.createDataFrame([(1, 0, "assistant", json.dumps({"tool_calls": calls[::-1]}), "x", 1)], SCHEMA)
    made = json.loads(chat.format_chat(df).first()["json"])["tool_calls"]
    assert [(c["id"], c["level"]) for c in made] == [(str(i), i) for i in range(6)]


def test_tools_that_conversations_declare(spark):
    place = {"type": "object", "properties": {"city": {"type": "string"}, "at": {"type": "array", "items": {"type": "number"}}}, "required": ["city"], "additionalProperties": False}
    go = {"type": "object", "properties": {"to": place, "by": {"enum": ["air", "sea", 3]}, "n": {"type": ["integer", "null"]}, "stops": {"type": "array", "items": place}}, "required": ["to"]}
    system = json.dumps({"tools": [{"type": "function", "function": {"name": "go", "parameters": go}}, {"name": "free"}, {"name": "go", "parameters": {}}, {"noname": 1}]})
    args = {
        "good": {"to": {"city": "X", "at": [1, 2.5]}, "by": "sea", "n": None, "stops": [{"city": "Y"}], "else": 1},
        "deep": {"to": {"at": [1, "2"], "zip": 9}, "by": "car", "n": 1.5, "stops": [{"city": "Y"}, {"city": 4}]},
        "flat": {"to": "X", "by": 3, "n": 7, "stops": {}},
        "none": {},
    }
    calls = [{"id": k, "name": "go", "arguments": a} for k, a in args.items()] + [{"id": "f", "name": "free", "arguments": {"any": [1]}}, {"id": "u", "name": "nope", "arguments": {}}, {"id": "l", "name": "go", "arguments": [1]}]
    rows = [(1, 0, "system", system), (1, 1, "assistant", json.dumps({"tool_calls": calls})), (2, 0, "system", "plain"), (2, 1, "assistant", json.dumps({"tool_calls": calls[5:6]})), (None, 0, "system", system), (3, 0, "system", json.dumps({"tools": 5})), (4, 0, "system", None), (4, 0, "system", "")]
    rows += rows[:1]
    out = chat.format_chat(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    assert len(out) == len(rows)
    got = {(r["conv_id"], r["turn"]): r for r in out}
    assert {c["id"]: c.get("errors", []) for c in json.loads(got[1, 1]["json"])["tool_calls"]} == {
        "good": [], "f": [], "u": ["unknown tool"], "l": ["arguments are no object"], "none": ["missing argument to"],
        "flat": ["wrong type of stops", "wrong type of to"],
        "deep": ["missing argument to.city", "unknown argument to.zip", "value not allowed for by", "wrong type of n", "wrong type of stops[1].city", "wrong type of to.at[1]"],
    }
    assert got[1, 1]["n_invalid"] == 5 and got[2, 1]["n_invalid"] == 0


def test_long_texts_and_many_calls(spark):
    calls = [{"id": str(i), "name": "f", "arguments": {"x": i}} for i in range(3000)]
    long = "z" * 2_000_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", json.dumps({"tool_calls": calls})), *[(1, 2 + i, "tool", json.dumps({"tool_call_id": str(i), "content": "r"})) for i in range(50)]]
    got = {r["turn"]: r for r in chat.format_chat(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()}
    assert json.loads(got[0]["json"])["content"] == long and (got[1]["n_calls"], got[1]["n_linked"], got[1]["n_invalid"]) == (3000, 50, 0)
    assert [c["id"] for c in json.loads(got[1]["json"])["tool_calls"]] == [str(i) for i in range(3000)]
