"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON, natively.

A message is a row (conversation, turn, role, text). An assistant's text that is a JSON object with an array
`tool_calls` makes calls: `id`, `name`, `arguments` (an object, or a string that holds one) and optionally `depends_on`,
ids of calls whose results it needs. A tool's text that is an object with `tool_call_id` is a result. All other texts are
plain content. A system's text that is an object with an array `tools` declares tools with JSON schemas for the
conversation: `name` and `parameters`, or both inside `function`. Calls and results meet in a join by (conversation, id),
calls and schemas in one by (conversation, name). Rows stay messages, so that a conversation of any length is never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Copies of a declared tool, so that the calls of one tool in a long conversation are joined with it in that many tasks.
SALT = 8


def _type_matches(value: Column, kind: Column) -> Column:
    """Whether a variant has a JSON schema type; an unknown type matches nothing."""
    found = F.schema_of_variant(value)
    whole = (found == "BIGINT") | found.rlike(r"^DECIMAL\(\d+,0\)$")
    return (
        F.when(kind == "string", found == "STRING").when(kind == "integer", whole).when(kind == "number", whole | found.startswith("DECIMAL") | (found == "DOUBLE"))
        .when(kind == "boolean", found == "BOOLEAN").when(kind == "object", found.startswith("OBJECT")).when(kind == "array", found.startswith("ARRAY")).when(kind == "null", found == "VOID")
        .otherwise(F.lit(False))
    )


def tool_calls(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, idx, id, name, args, depends_on): `args` a map of variants, null if they aren't an object."""
    parsed = messages.where("role = 'assistant'").withColumn("v", F.try_parse_json("text"))
    made = parsed.select("conv_id", "turn", F.posexplode(F.try_variant_get("v", "$.tool_calls", "array<variant>")).alias("idx", "c"))
    get = lambda path, kind="string": F.try_variant_get("c", path, kind)
    return made.select("conv_id", "turn", "idx", get("$.id").alias("id"), get("$.name").alias("name"), F.from_json(get("$.arguments"), "map<string,variant>").alias("args"), F.coalesce(get("$.depends_on", "array<string>"), F.array().cast("array<string>")).alias("depends_on"))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, id, level): the topological level of each call, 0 without dependencies; calls on or behind a cycle are left out.

    A round places the calls whose dependencies are all placed; each is written, so their number is that of the longest
    chain. Dependencies on ids that the conversation doesn't have are ignored here.
    """
    nodes = calls.where("id IS NOT NULL").select("conv_id", "id").distinct()
    edges = calls.select("conv_id", "id", F.explode("depends_on").alias("dep")).join(nodes.withColumnRenamed("id", "dep"), ["conv_id", "dep"], "left_semi").distinct()
    edges = shared.written(edges, "call-edges")
    placed = nodes.join(edges, ["conv_id", "id"], "left_anti").withColumn("level", F.lit(0))
    if edges.isEmpty():
        return placed
    placed = shared.written(placed, "call-levels")
    at = 0
    while True:
        at += 1
        open_ = edges.join(placed.select("conv_id", "id"), ["conv_id", "id"], "left_anti")
        ready = open_.join(placed.select("conv_id", F.col("id").alias("dep"), F.lit(True).alias("done")), ["conv_id", "dep"], "left")
        ready = ready.groupBy("conv_id", "id").agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("all")).where("all").select("conv_id", "id", F.lit(at).alias("level"))
        ready = shared.written(ready, "call-levels")
        if ready.isEmpty():
            return placed
        placed = placed.unionByName(ready)


def declared_tools(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, name, schema): the tools that system messages declare, of one name the first; `schema` is JSON, null if none."""
    parsed = messages.where("role = 'system'").withColumn("v", F.try_parse_json("text"))
    named = parsed.select("conv_id", "turn", F.posexplode(F.try_variant_get("v", "$.tools", "array<variant>")).alias("idx", "t"))
    named = named.withColumn("f", F.coalesce(F.try_variant_get("t", "$.function", "variant"), F.col("t")))
    named = named.select("conv_id", "turn", "idx", F.try_variant_get("f", "$.name", "string").alias("name"), F.try_variant_get("f", "$.parameters", "string").alias("schema"))
    return named.where("name IS NOT NULL").groupBy("conv_id", "name").agg(F.min(F.struct("turn", "idx", "schema")).alias("first")).select("conv_id", "name", "first.schema")


def schema_errors(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """(conv_id, turn, idx, found): what is wrong with calls by the tools that their own conversations declare.

    Checked are `type` (one or several), `enum`, `required`, `properties`, `additionalProperties: false` and `items`, at
    any depth: a round checks the values of one depth and goes on with their members, each a row; rounds are written, so
    their number is the depth of the schemas. Other keywords are ignored. A conversation without tools isn't checked.
    """
    key = ["conv_id", "turn", "idx"]
    salted = tools.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    own = calls.join(tools.select("conv_id").distinct(), "conv_id", "left_semi").select(*key, "name", F.to_json("args").alias("value"))
    own = own.withColumn("salt", F.pmod(F.xxhash64("turn", "idx"), F.lit(SALT)).cast("int"))
    met = own.join(salted.withColumn("known", F.lit(True)), ["conv_id", "name", "salt"], "left")
    errors = met.where("known IS NULL").select(*key, F.lit("unknown tool").alias("error"))
    nodes = met.where("value IS NOT NULL AND schema IS NOT NULL").select(*key, F.lit("").alias("path"), "value", "schema")
    members = lambda c: F.from_json(c, "map<string,variant>")
    of = lambda what, kind: F.try_variant_get("s", what, kind)
    below = lambda k: F.concat("path", F.when(F.col("path") == "", "").otherwise("."), k)
    while True:
        v = nodes.withColumn("v", F.try_parse_json("value")).withColumn("s", F.try_parse_json("schema"))
        v = v.withColumn("kinds", F.coalesce(of("$.type", "array<string>"), F.array_compact(F.array(of("$.type", "string"))))).withColumn("enum", of("$.enum", "array<variant>"))
        is_object = F.schema_of_variant("v").startswith("OBJECT")
        v = v.withColumn("own", F.when(is_object, members(F.col("value")))).withColumn("props", F.coalesce(members(of("$.properties", "string")), members(F.lit("{}"))))
        v = v.withColumn("values", F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>"))).withColumn("items", of("$.items", "string"))
        here = lambda c: F.when(F.col("path") == "", F.lit("arguments")).otherwise(F.col("path")) if c is None else below(c)
        told = F.concat(
            F.when((F.size("kinds") > 0) & ~F.exists("kinds", lambda k: _type_matches(F.col("v"), k)), F.array(F.concat(F.lit("wrong type of "), here(None)))).otherwise(F.array().cast("array<string>")),
            F.when(F.col("enum").isNotNull() & ~F.exists("enum", lambda e: F.to_json(e) == F.to_json("v")), F.array(F.concat(F.lit("value not allowed for "), here(None)))).otherwise(F.array().cast("array<string>")),
            F.when(is_object, F.transform(F.filter(F.coalesce(of("$.required", "array<string>"), F.array().cast("array<string>")), lambda k: ~F.map_contains_key("own", k)), lambda k: F.concat(F.lit("missing argument "), here(k)))).otherwise(F.array().cast("array<string>")),
            F.when(is_object & ~F.coalesce(of("$.additionalProperties", "boolean"), F.lit(True)), F.transform(F.filter(F.map_keys("own"), lambda k: ~F.map_contains_key("props", k)), lambda k: F.concat(F.lit("unknown argument "), here(k)))).otherwise(F.array().cast("array<string>")),
        )
        inner = F.concat(
            F.coalesce(F.transform(F.filter(F.map_keys("own"), lambda k: F.map_contains_key("props", k)), lambda k: F.struct(below(k).alias("path"), F.to_json(F.element_at("own", k)).alias("value"), F.to_json(F.element_at("props", k)).alias("schema"))), F.array().cast("array<struct<path:string,value:string,schema:string>>")),
            F.coalesce(F.when(F.col("items").isNotNull(), F.transform("values", lambda x, i: F.struct(F.concat("path", F.lit("["), i.cast("string"), F.lit("]")).alias("path"), F.to_json(x).alias("value"), F.col("items").alias("schema")))), F.array().cast("array<struct<path:string,value:string,schema:string>>")),
        )
        done = shared.written(v.select(*key, told.alias("told"), inner.alias("inner")), "schema-checks")
        errors = errors.unionByName(done.select(*key, F.explode("told").alias("error")))
        nodes = done.select(*key, F.explode("inner").alias("m")).select(*key, "m.path", "m.value", "m.schema")
        if nodes.isEmpty():
            return errors.groupBy(*key).agg(F.collect_set("error").alias("found"))


def format_chat(messages: DataFrame, tools: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, n_calls, n_linked, n_invalid, json.

    `tools` has `name` and `parameters`, an array of structs (name, type, required). A call is invalid if its tool is
    unknown, its arguments are no object, one is missing, unknown or of another type, its id is missing or was used
    before in the conversation, it depends on an unknown id, or on itself over others. Tools that a conversation declares
    itself are checked by their JSON schemas, nested ones too (`schema_errors`), beside those of `tools`. Without either,
    arguments and tool names aren't checked. `json` has sorted keys; calls stand in topological order, ties by place, each with the turn of
    its result. A result has `linked`: whether the conversation has its call.

    Of several calls with one id the first by (turn, place) is linked, of several results the first by turn is named.
    Null and empty texts are plain content, null left out; what stands in a null conversation or turn is plain content
    too. Repeated rows are rows of their own, each with the calls of all rows of its turn, whose ids then are repeated.
    An empty table gives an empty result. Other columns are ignored.
    """
    base = messages.select(messages[conv_id].alias("conv_id"), messages[turn].alias("turn"), messages[role].alias("role"), messages[text].cast("string").alias("text"))
    calls = tool_calls(base)
    answer = base.where("role = 'tool'").withColumn("id", F.try_variant_get(F.try_parse_json("text"), "$.tool_call_id", "string")).where("id IS NOT NULL")
    results = answer.groupBy("conv_id", "id").agg(F.min("turn").alias("result_turn"))
    firsts = calls.where("id IS NOT NULL").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "idx")).alias("first"), F.count("*").alias("uses"))
    linked = calls.join(results, ["conv_id", "id"], "left").join(firsts, ["conv_id", "id"], "left").join(levels(calls), ["conv_id", "id"], "left")
    wanted = calls.select("conv_id", "turn", "idx", F.explode("depends_on").alias("dep")).join(firsts.select("conv_id", F.col("id").alias("dep")), ["conv_id", "dep"], "left_anti").select("conv_id", "turn", "idx", F.lit(True).alias("loose")).distinct()
    linked = linked.join(wanted, ["conv_id", "turn", "idx"], "left")
    own_first = (F.col("first.turn") == F.col("turn")) & (F.col("first.idx") == F.col("idx"))
    problems = [
        F.when(F.col("id").isNull(), F.lit("no id")),
        F.when(F.col("uses") > 1, F.when(~own_first, F.lit("repeated id"))),
        F.when(F.col("loose"), F.lit("unknown dependency")),
        F.when(F.col("id").isNotNull() & F.col("level").isNull(), F.lit("circular dependency")),
        F.when(F.col("args").isNull(), F.lit("arguments are no object")),
    ]
    errors = F.array_compact(F.array(*problems))
    if tools is not None:
        known = tools.groupBy(F.col("name").alias("name")).agg(F.first("parameters").alias("parameters"))
        linked = linked.join(known, "name", "left")
        params, args = F.col("parameters"), F.coalesce("args", F.from_json(F.lit("{}"), "map<string,variant>"))
        checks = F.when(params.isNull(), F.array(F.lit("unknown tool"))).otherwise(F.concat(
            F.transform(F.filter(params, lambda p: p["required"] & ~F.map_contains_key(args, p["name"])), lambda p: F.concat(F.lit("missing argument "), p["name"])),
            F.transform(F.filter(F.map_keys(args), lambda k: ~F.exists(params, lambda p: p["name"] == k)), lambda k: F.concat(F.lit("unknown argument "), k)),
            F.transform(F.filter(params, lambda p: F.map_contains_key(args, p["name"]) & ~_type_matches(F.element_at(args, p["name"]), p["type"])), lambda p: F.concat(F.lit("wrong type of "), p["name"])),
        ))
        errors = F.concat(errors, checks)
    linked = linked.withColumn("errors", errors)
    declared = shared.written(declared_tools(base), "declared-tools")
    if not declared.isEmpty():
        linked = linked.join(schema_errors(calls, declared), ["conv_id", "turn", "idx"], "left").withColumn("errors", F.concat("errors", F.coalesce("found", F.array().cast("array<string>")))).drop("found")
    linked = linked.withColumn("errors", F.sort_array(F.array_distinct("errors")))
    arguments = F.parse_json(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("args"), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))))
    told = F.struct(arguments.alias("arguments"), F.when(F.size("depends_on") > 0, F.col("depends_on")).alias("depends_on"), F.when(F.size("errors") > 0, F.col("errors")).alias("errors"), "id", "level", "name", "result_turn")
    order = F.struct(F.coalesce("level", F.lit(2**31 - 1)).alias("level"), F.col("idx").alias("idx"), F.to_json(told).alias("json"))
    by_message = linked.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(order)).alias("made"), F.count("*").alias("n_calls"), F.count("result_turn").alias("n_linked"), F.count(F.when(F.size("errors") > 0, 1)).alias("n_invalid"))
    joined = base.join(by_message.withColumn("role", F.lit("assistant")), ["conv_id", "turn", "role"], "left")
    joined = joined.withColumn("id", F.when(F.col("role") == "tool", F.try_variant_get(F.try_parse_json("text"), "$.tool_call_id", "string"))).join(firsts.select("conv_id", "id", F.lit(True).alias("has_call")), ["conv_id", "id"], "left")
    parsed = F.try_parse_json("text")
    content = F.when(F.col("made").isNotNull() | F.col("id").isNotNull(), F.try_variant_get(parsed, "$.content", "string")).otherwise(F.col("text"))
    field = lambda name, json: F.concat(F.lit(f'"{name}":'), json)
    quoted = lambda c: F.expr(f"substring(to_json(struct({c} AS x)), 6, length(to_json(struct({c} AS x))) - 6)")
    joined = joined.withColumn("content", content)
    parts = F.array_compact(F.array(
        F.when(F.col("content").isNotNull(), field("content", quoted("content"))),
        F.when(F.col("id").isNotNull(), field("linked", F.when(F.coalesce("has_call", F.lit(False)), F.lit("true")).otherwise(F.lit("false")))),
        F.when(F.col("role").isNotNull(), field("role", quoted("role"))),
        F.when(F.col("id").isNotNull(), field("tool_call_id", quoted("id"))),
        F.when(F.col("made").isNotNull(), field("tool_calls", F.concat(F.lit("["), F.array_join(F.transform("made", lambda m: m["json"]), ","), F.lit("]")))),
    ))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = joined.select("conv_id", "turn", "role", zero("n_calls"), zero("n_linked"), zero("n_invalid"), F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("json"))
    return out.withColumnsRenamed({"conv_id": conv_id, "turn": turn, "role": role})


def op10(spark, sf_dir: str) -> DataFrame:
    """All messages in canonical JSON with their tool calls linked, arguments checked by the tools that the conversations declare."""
    return format_chat(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: For messages without tool calls, as in the tables that the oracle sees; calls are tested on a fixture.
OP10_SQL = """
SELECT conv_id, turn, role, CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_linked, CAST(0 AS BIGINT) AS n_invalid,
       '{' || coalesce('"content":' || CAST(to_json(text) AS VARCHAR) || ',', '') || '"role":' || CAST(to_json(role) AS VARCHAR) || '}' AS json
FROM conversations
"""
