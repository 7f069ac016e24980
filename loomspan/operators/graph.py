"""Versionless graph state: nodes of fields (scalars as JSON text, links, bytes, blobs) and sets of members.

`fields` is (node, field, kind, value), kind one of scalar, link, bytes, blob, set; `members` is (node, field, member).
`nodes` lists all known ids; without it every node with a field or set is known.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.errors import TraversalIntoScalar, TraversalIntoSet
from loomspan.functions.scalar import Json, JsonText, Value
from loomspan.operators import predicates, traverse
from loomspan.plans import specs

FIELDS = "node string, field string, kind string, value string"
MEMBERS = "node string, field string, member string"


@dataclass(frozen=True)
class Cursor:
    """Where a path leads: kind is absent, scalar, node (a link's target or a root) or set."""

    kind: str
    node: str | None = None
    field: str | None = None
    value: str | None = None


class Graph:
    """Queries over state tables; every method but the path look-ups returns a lazy DataFrame."""

    def __init__(self, fields: DataFrame, members: DataFrame, nodes: DataFrame | None = None):
        self.fields = fields.select("node", "field", "kind", "value")
        self.members = members.select("node", "field", "member")
        self.nodes = nodes.select("node").distinct() if nodes is not None else self.fields.select("node").unionByName(self.members.select("node")).distinct()

    @property
    def spark(self) -> SparkSession:
        return self.fields.sparkSession

    # paths

    def cursor(self, path: str) -> Cursor:
        """Follows `root.field.field`, a row look-up for each segment. Segments behind a scalar or a set are errors."""
        root, *segments = path.split(".")
        at = Cursor("node", root)
        for i, s in enumerate(segments):
            if at.kind == "scalar":
                raise TraversalIntoScalar(path)
            if at.kind == "set":
                raise TraversalIntoSet(path)
            row = self.fields.where((F.col("node") == at.node) & (F.col("field") == s)).first()
            if row is None:
                held = self.members.where((F.col("node") == at.node) & (F.col("field") == s)).first()
                if held is None:
                    return Cursor("absent")
                at = Cursor("set", at.node, s)
            elif row["kind"] == "link":
                at = Cursor("node", row["value"])
            elif row["kind"] == "set":
                at = Cursor("set", at.node, s)
            else:
                at = Cursor("scalar", at.node, s, row["value"])
        return at

    def get(self, path: str, max_depth: int | None = None) -> str | None:
        """The value at a path as JSON, deeply materialised; None if absent."""
        at = self.cursor(path)
        if at.kind == "absent":
            return None
        if at.kind == "scalar":
            return at.value
        if at.kind == "set":
            rows = self._set(at).select(F.col("member").alias("root"))
            return json.dumps({"$set": [json.loads(r["value"]) for r in self.materialize(rows, max_depth).orderBy("root").collect()]}, ensure_ascii=False, separators=(",", ":"))
        row = self.materialize(self.spark.createDataFrame([(at.node,)], "root string"), max_depth).first()
        return row["value"] if row else None

    def node_state(self, node: str) -> DataFrame:
        return self.fields.where(F.col("node") == node)

    def _set(self, at: Cursor) -> DataFrame:
        return self.members.where((F.col("node") == at.node) & (F.col("field") == at.field))

    def entries(self, path: str) -> DataFrame:
        """(key, kind, value): a node's fields, or a set's members as links; nothing for scalars and absent paths."""
        at = self.cursor(path)
        if at.kind == "node":
            return self.node_state(at.node).select(F.col("field").alias("key"), "kind", "value")
        if at.kind == "set":
            return self._set(at).select(F.col("member").alias("key"), F.lit("link").alias("kind"), F.col("member").alias("value"))
        return self.spark.createDataFrame([], "key string, kind string, value string")

    # materialisation

    def shallow(self, nodes: DataFrame) -> DataFrame:
        """(node, value): a JSON object with fields by name; links and members stay links."""
        own = self.fields.where("kind <> 'set'").select("node", "field", _text().alias("text"))
        sets = self.members.groupBy("node", "field").agg(F.sort_array(F.collect_list("member")).alias("m"))
        sets = sets.select("node", "field", F.concat(F.lit('{"$set":['), F.array_join(F.transform("m", lambda m: F.concat(F.lit('{"$link":'), _quoted(m), F.lit("}"))), ","), F.lit("]}")).alias("text"))
        rows = nodes.select("node").distinct().join(own.unionByName(sets), "node", "left")
        pair = F.when(F.col("field").isNotNull(), F.struct("field", F.concat(_quoted(F.col("field")), F.lit(":"), "text").alias("pair")))
        made = rows.groupBy("node").agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
        head = F.concat(F.lit('"$id":'), _quoted(F.col("node")))
        return made.select("node", F.concat(F.lit("{"), F.array_join(F.concat(F.array(head), F.transform("pairs", lambda p: p["pair"])), ","), F.lit("}")).alias("value"))

    def materialize(self, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
        """(root, value): nested JSON of each known root. A node on the current path, an unknown one, or one beyond `max_depth` is {"$ref": id}.

        The documents' places are found from the top, a level at a time, and their values put together from the bottom, so
        the rows are those of the documents themselves and no task holds more than it writes. Levels are written unless
        `max_depth` says that they are few. Scalars stand as they are stored.
        """
        few = max_depth is not None and max_depth <= 2
        edges = self.edges().select(F.col("source").alias("node"), "field", "target", "kind")
        known = self.nodes.select(F.col("node").alias("target"), F.lit(True).alias("known"))
        at = roots.select(F.col("root").alias("node")).distinct().join(self.nodes, "node", "left_semi")
        places, steps = [at.select(F.array("node").alias("place"), F.array("node").alias("path"), "node")], []
        while True:
            inner = max_depth is None or len(steps) < max_depth
            step = places[-1].join(edges, "node").select("place", "path", "field", "kind", "target")
            if inner:
                step = step.join(known, "target", "left").withColumn("open", F.coalesce("known", F.lit(False)) & ~F.array_contains("path", F.col("target"))).drop("known")
                step = step if few else traverse.written(step, "places")
            steps.append(step)
            if not inner or (not few and step.where("open").isEmpty()):
                break
            below = step.where("open")
            places.append(below.select(F.concat("place", F.array("field", "target")).alias("place"), F.concat("path", F.array("target")).alias("path"), F.col("target").alias("node")))
        value = None
        for place, step in zip(reversed(places), reversed(steps)):
            value = self._put_together(place, step, value)
        return value.select(F.col("place")[0].alias("root"), "value")

    def _put_together(self, places: DataFrame, steps: DataFrame, below: DataFrame | None) -> DataFrame:
        """(place, value) of one level: fields by name, with the values of the level below or references to its nodes."""
        ref = F.concat(F.lit('{"$ref":'), _quoted(F.col("target")), F.lit("}"))
        if below is None:
            linked = steps.withColumn("text", ref)
        else:
            linked = steps.withColumn("under", F.concat("place", F.array("field", "target"))).join(below.select(F.col("place").alias("under"), F.col("value").alias("text")), "under", "left")
            linked = linked.withColumn("text", F.coalesce("text", ref))
        own = places.join(self.fields.where("kind <> 'link'"), "node", "left").select("place", "field", "kind", F.lit(None).cast("string").alias("target"), _text().alias("text"))
        rows = own.unionByName(linked.select("place", "field", "kind", "target", "text")).repartition("place")
        held = F.sort_array(F.collect_list(F.when(F.col("kind") == "member", F.struct("target", "text"))))
        fields = rows.groupBy("place", "field").agg(held.alias("held"), F.bool_or(F.col("kind").isin("set", "member")).alias("many"), F.min(F.when(~F.col("kind").isin("set", "member"), F.coalesce("text", F.lit("null")))).alias("text"))
        members = F.concat(F.lit('{"$set":['), F.array_join(F.transform("held", lambda m: m["text"]), ","), F.lit("]}"))
        pair = F.when(F.col("field").isNotNull(), F.struct("field", F.concat(_quoted(F.col("field")), F.lit(":"), F.when(F.col("many"), members).otherwise(F.col("text"))).alias("pair")))
        made = fields.groupBy("place").agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
        head = F.concat(F.lit('"$id":'), _quoted(F.element_at("place", -1)))
        return made.select("place", F.concat(F.lit("{"), F.array_join(F.concat(F.array(head), F.transform("pairs", lambda p: p["pair"])), ","), F.lit("}")).alias("value"))

    # queries

    def query(self, path: str, spec: dict | None = None, max_depth: int | None = None) -> DataFrame:
        """(key, value) of the entries at a path that pass the filters, ordered and paged; values are materialised after the page is cut."""
        spec = specs.query(spec)
        walk = _Walk(self, self.entries(path), max_depth)
        whole = {f["path"] for f in spec["filters"] if isinstance(f.get("value"), (dict, list))}
        condition = predicates.conjunction(spec["filters"], lambda p: walk.value(p, p in whole))
        by, descending = F.lit(None), False
        if spec["order"]:
            by, descending = walk.value(spec["order"]["path"]).v, spec["order"].get("direction", "asc") == "desc"
        rows = walk.df if condition is None else walk.df.where(condition)
        rows = rows.select("key", "kind", "value", by.alias("__by"))
        order = [*Json(F.col("__by")).order(descending), F.asc("key")] if spec["order"] else [F.asc("key")]
        page = traverse.written(predicates.paged(rows, order, spec["offset"], spec["limit"]), "page")  # read for its roots and for itself
        roots = page.where("kind = 'link'").select(F.col("value").alias("root")).distinct()
        deep = self.materialize(roots, max_depth).withColumnRenamed("value", "deep")
        out = page.join(deep, (page["value"] == deep["root"]) & (page["kind"] == "link"), "left")
        ref = F.when(F.col("kind") == "link", F.concat(F.lit('{"$ref":'), _quoted(page["value"]), F.lit("}")))
        return out.select("__by", "key", F.coalesce("deep", ref, page["value"]).alias("value")).orderBy(*order).select("key", "value")

    def map(self, path: str) -> DataFrame:
        return self.query(path)

    def first(self, path: str, spec: dict | None = None) -> DataFrame:
        return self.query(path, (spec or {}) | {"limit": 1})

    # lexical scan

    def lex(self, path: str, spec: dict | None = None) -> DataFrame:
        """(path, key, kind, value) in pre-order: keys in range at every level; a key out of range hides what is below.

        With follow_links, link targets and members are entered down to `depth`. `reverse` turns the whole list round
        before `limit` cuts it.
        """
        spec = specs.filled(spec, specs.LEX)
        inside = lambda key: predicates.key_range(key, *[spec[k] for k in ("prefix", "start_at", "start_after", "end_at", "end_before")])
        level = self.entries(path).where(inside(F.col("key"))).select(F.array("key").alias("keys"), "key", "kind", "value")
        at = self.cursor(path)
        if at.kind == "node":
            level = level.withColumn("owner", F.lit(at.node))
        else:
            level = level.withColumn("owner", F.lit(None).cast("string"))
        found, depth = level, 1
        while spec["follow_links"] and depth < spec["depth"]:
            depth += 1
            below = level.where("kind = 'link'").select(F.col("keys").alias("up"), F.col("value").alias("node")).join(self.fields, "node")
            below = below.select(F.concat("up", F.array("field")).alias("keys"), F.col("field").alias("key"), "kind", "value", F.col("node").alias("owner"))
            sets = level.where("kind = 'set'").select(F.col("keys").alias("up"), F.col("owner").alias("node"), F.col("key").alias("field")).join(self.members, ["node", "field"])
            sets = sets.select(F.concat("up", F.array("member")).alias("keys"), F.col("member").alias("key"), F.lit("link").alias("kind"), F.col("member").alias("value"), F.lit(None).cast("string").alias("owner"))
            level = below.unionByName(sets).where(inside(F.col("key")))
            found = found.unionByName(level)
        order = F.desc("keys") if spec["reverse"] else F.asc("keys")
        found = found.orderBy(order) if spec["limit"] is None else predicates.paged(found, [order], 0, spec["limit"])
        return found.select(F.array_join("keys", ".").alias("path"), "key", "kind", "value")

    # edges

    def edges(self) -> DataFrame:
        """(source, field, target, kind) of all links and memberships."""
        links = self.fields.where("kind = 'link'").select(F.col("node").alias("source"), "field", F.col("value").alias("target"), F.lit("link").alias("kind"))
        return links.unionByName(self.members.select(F.col("node").alias("source"), "field", F.col("member").alias("target"), F.lit("member").alias("kind")))

    def traverse(self, path: str, spec: dict | None = None) -> traverse.Traversal:
        """Walks from a node, a link's target or all members of a set."""
        at = self.cursor(path)
        if at.kind == "node":
            starts = self.spark.createDataFrame([(at.node, 0)], "node string, ordinal long")
        elif at.kind == "set":
            starts = self._set(at).select(F.col("member").alias("node"))
        else:
            starts = self.spark.createDataFrame([], "node string, ordinal long")

        def resolve(rows: DataFrame, filters: list[dict]):
            """Filters see the node's shallow value: dotted paths lead into it, sets and links are objects, `$id` is the node."""
            own = self.shallow(rows.select("node")).withColumnRenamed("value", "__shallow")
            out = rows.join(own, "node", "left").withColumn("__shallow", F.try_parse_json("__shallow"))
            return out, lambda path: JsonText(F.to_json(F.try_variant_get("__shallow", _variant_path(path), "variant")))

        result = traverse.traverse(starts, self.edges(), self.nodes, spec, resolve)
        if specs.traversal(spec)["includeValues"]:
            shallow = self.shallow(result.rows.select("node"))
            result.rows = result.rows.join(shallow, "node", "left")
        return result

    def closure(self, root: str) -> "Graph":
        """The part of the graph that all nodes under a root reach."""
        kept = traverse.closure(traverse.root_nodes(self.nodes, root), self.edges())
        return Graph(self.fields.join(kept, "node", "left_semi"), self.members.join(kept, "node", "left_semi"), self.nodes.join(kept, "node", "left_semi"))

    def stats(self) -> DataFrame:
        """One row of counts: nodes, fields, links, sets and members."""
        counts = self.fields.agg(F.count("*").alias("fields"), F.count(F.when(F.col("kind") == "link", 1)).alias("links"))
        held = self.members.agg(F.count("*").alias("members"), F.countDistinct("node", "field").alias("sets"))
        return self.nodes.agg(F.count("*").alias("nodes")).crossJoin(counts).crossJoin(held)


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _marked(name: str, column: str) -> Column:
    return F.concat(F.lit(f'{{"{name}":'), _quoted(F.col(column)), F.lit("}"))


def _text() -> Column:
    """JSON of a field's value; links stay links."""
    kind = F.col("kind")
    return F.when(kind == "scalar", F.col("value")).when(kind == "link", _marked("$link", "value")).when(kind == "bytes", _marked("$bytes", "value")).when(kind == "blob", F.concat(F.lit('{"$blob":'), "value", F.lit("}")))


def _variant_path(path: str) -> str:
    """A dotted path into a JSON value; whole numbers index arrays."""
    quoted = [f"[{s}]" if s.isdigit() else "['" + s.replace("\\", "\\\\").replace("'", "\\'") + "']" for s in path.split(".")]
    return "$" + "".join(quoted)


class _Walk:
    """Entries with the values of paths joined beside them, each prefix once."""

    def __init__(self, graph: Graph, entries: DataFrame, max_depth: int | None):
        self.graph, self.df, self.max_depth = graph, entries, max_depth
        self.made: dict[str, str] = {}

    def value(self, path: str, whole: bool = False) -> Value:
        """The value behind a path. One that ends at a link or a set is materialised only if `whole`, for comparison with objects and lists."""
        if path == "$key":
            return JsonText(_quoted(F.col("key")))
        if path in ("", "$value"):
            if "__whole" not in self.df.columns:
                roots = self.df.where("kind = 'link'").select(F.col("value").alias("root")).distinct()
                deep = self.graph.materialize(roots, self.max_depth).select(F.col("root").alias("__root"), F.col("value").alias("__deep"))
                self.df = self.df.join(deep, (F.col("value") == F.col("__root")) & (F.col("kind") == "link"), "left").withColumn("__whole", F.coalesce("__deep", "value")).drop("__root", "__deep")
            return JsonText(F.col("__whole"))
        kind, value = F.col("kind"), F.col("value")
        walked = ""
        segments = path.split(".")
        for i, s in enumerate(segments):
            if s == "$id" and i == len(segments) - 1:
                return JsonText(F.when(kind == "link", _quoted(value)))
            walked = f"{walked}.{s}"
            name = self.made.get(walked)
            if name is None:
                name = self.made[walked] = f"__p{len(self.made)}"
                own = self.graph.fields.where(F.col("field") == s).select(F.col("node").alias("__n"), F.struct("kind", "value", F.col("node").alias("owner")).alias("__s"))
                sets = self.graph.members.where(F.col("field") == s).select(F.col("node").alias("__n")).distinct().withColumn("__s", F.struct(F.lit("set").alias("kind"), F.lit(None).cast("string").alias("value"), F.col("__n").alias("owner")))
                state = own.unionByName(sets.join(own.select("__n"), "__n", "left_anti"))
                inside = F.when(kind == "scalar", F.struct(F.lit("scalar").alias("kind"), F.to_json(F.try_variant_get(F.try_parse_json(value), _variant_path(s), "variant")).alias("value"), F.lit(None).cast("string").alias("owner")))
                inside = F.when(inside["value"].isNotNull(), inside)
                self.df = self.df.join(state, (kind == "link") & (value == F.col("__n")), "left").withColumn(name, F.coalesce("__s", inside)).drop("__n", "__s")
            kind, value = F.col(f"{name}.kind"), F.col(f"{name}.value")
        linked, held = F.concat(F.lit('{"$id":'), _quoted(value), F.lit("}")), F.lit('{"$set":[]}')
        if whole:
            linked, held = self._materialised(name, segments[-1])
        marked = F.when(kind == "bytes", F.concat(F.lit('{"$bytes":'), _quoted(value), F.lit("}"))).when(kind == "blob", F.concat(F.lit('{"$blob":'), value, F.lit("}")))
        return JsonText(F.when(kind == "scalar", value).when(kind == "link", linked).when(kind == "set", held).otherwise(marked))

    def _materialised(self, name: str, field: str) -> tuple[Column, Column]:
        """Deep values of the links and sets that the state `name` holds, joined beside the entries."""
        self.df = self.df.withColumn(f"{name}o", F.col(f"{name}.owner"))
        links = self.df.where(F.col(f"{name}.kind") == "link").select(F.col(f"{name}.value").alias("root"))
        owners = self.df.where(F.col(f"{name}.kind") == "set").select(F.col(f"{name}o").alias("node")).distinct()
        members = self.graph.members.where(F.col("field") == field).join(owners, "node", "left_semi")
        deep = traverse.written(self.graph.materialize(links.unionByName(members.select(F.col("member").alias("root"))).distinct(), self.max_depth), "deep")
        sets = members.join(deep.withColumnRenamed("root", "member"), "member").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("member", "value"))).alias("m"))
        sets = sets.select(F.col("node").alias(f"{name}sn"), F.concat(F.lit('{"$set":['), F.array_join(F.transform("m", lambda m: m["value"]), ","), F.lit("]}")).alias(f"{name}s"))
        deep = deep.select(F.col("root").alias(f"{name}dn"), F.col("value").alias(f"{name}d"))
        self.df = self.df.join(deep, (F.col(f"{name}.kind") == "link") & (F.col(f"{name}.value") == F.col(f"{name}dn")), "left").join(sets, (F.col(f"{name}.kind") == "set") & (F.col(f"{name}o") == F.col(f"{name}sn")), "left")
        return F.coalesce(f"{name}d", F.concat(F.lit('{"$ref":'), _quoted(F.col(f"{name}.value")), F.lit("}"))), F.coalesce(f"{name}s", F.lit('{"$set":[]}'))
