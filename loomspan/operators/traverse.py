"""Graph traversal over an edge table (source, field, target, kind), kind `link` or `member`.

Breadth first is one join of the frontier with the edges for each level. Rows get the rank at which a queue would pop
them: by the rank of their parent, then by edge. So limits and flags are those of the sequential walk. The walk depth first is
sequential by nature: it runs on the driver over the reachable edges, with a stated bound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.errors import InvalidSpec
from loomspan.operators.predicates import conjunction, paged
from loomspan.plans import specs
from loomspan.sources.tables import written


@dataclass
class Traversal:
    """Rows (rank, node, depth, path, via), and what the walk left out: missing ids as rows, two flags."""

    rows: DataFrame
    missing: DataFrame
    depth_limit_reached: bool
    result_limit_reached: bool

    @property
    def complete(self) -> bool:
        return not self.depth_limit_reached and not self.result_limit_reached and self.missing.isEmpty()


def oriented(edges: DataFrame, spec: dict) -> DataFrame:
    """(from, to, source, field, target, kind) of the edges the spec follows, in its direction."""
    if spec["edgeFields"] is not None:
        edges = edges.where(F.col("field").isin(list(spec["edgeFields"])))
    if not spec["followLinks"]:
        edges = edges.where("kind <> 'link'")
    if not spec["followSets"]:
        edges = edges.where("kind <> 'member'")
    out = edges.select(F.col("source").alias("from"), F.col("target").alias("to"), "source", "field", "target", "kind")
    back = edges.select(F.col("target").alias("from"), F.col("source").alias("to"), "source", "field", "target", "kind")
    if spec["direction"] == "inbound":
        return back
    return out.unionByName(back) if spec["direction"] == "both" else out


_VIA = "struct<source:string,field:string,target:string,kind:string>"


def levels(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Every node that can be reached within `depth`, once, with the path and edge by which a queue meets it first.

    `rank` orders the nodes of a depth as the queue pops them: the rank of the parent, then the edge, as an array of
    strings that compares from left to right. So no level has to be numbered.
    """
    first = F.col("ordinal") if dict(starts.dtypes)["ordinal"] == "string" else F.lpad(F.col("ordinal").cast("string"), 19, "0")
    seen = starts.select("node", F.lit(0).alias("depth"), F.array("node").alias("path"), F.lit(None).cast(_VIA).alias("via"), F.array(first).alias("rank"))
    seen = written(seen.groupBy("node").agg(F.min_by(F.struct("depth", "path", "via"), "rank").alias("s"), F.min("rank").alias("rank")).select("node", "s.*", "rank"), "level")
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.select(F.col("node").alias("from"), F.col("path").alias("way"), F.col("rank").alias("parent")).join(edges, "from")
        step = step.join(seen.select(F.col("node").alias("to")), "to", "left_anti")
        place = F.struct("parent", "source", "field", "target", "kind")
        best = step.groupBy(F.col("to").alias("node")).agg(F.min(place).alias("place"), F.min_by("way", place).alias("way"))
        via = ["place.source", "place.field", "place.target", "place.kind"]
        best = best.select("node", F.lit(d).alias("depth"), F.concat("way", F.array("node")).alias("path"), F.struct(*via).alias("via"), F.concat("place.parent", F.array(*via)).alias("rank"))
        frontier = written(best, "level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def traverse(starts: DataFrame, edges: DataFrame, nodes: DataFrame, spec: dict | None = None, resolve=None, max_edges: int = 1_000_000) -> Traversal:
    """Walks from `starts` (node, or ordinal and node; without numbers in the nodes' order) over `edges`; `nodes` are the known ids.

    resolve(rows, filters) -> (rows, path -> Value) puts the columns that filters need beside the rows' nodes. Filters
    decide what is returned, not what is followed.
    """
    spec = specs.traversal(spec)
    if "ordinal" not in starts.columns:
        starts = starts.withColumn("ordinal", F.col("node"))
    ways = oriented(edges, spec).distinct()
    if spec["strategy"] == "dfs":
        seen = depth_first(starts, ways, spec["maxDepth"], max_edges)
    else:
        seen = levels(starts, ways, spec["maxDepth"])
    known = nodes.select("node").distinct().withColumn("known", F.lit(True))
    seen = written(seen.join(known, "node", "left").withColumn("known", F.coalesce("known", F.lit(False))), "seen")
    rows = seen.where("known")
    if not spec["includeStart"]:
        rows = rows.where("depth > 0")
    if spec["filters"]:
        if resolve is None:
            raise InvalidSpec("filters need a resolver")
        rows, value = resolve(rows, spec["filters"])
        rows = rows.where(conjunction(spec["filters"], value))
    rows = rows.select("depth", "rank", "node", "path", "via")
    popped, over = seen, False
    if spec["limit"] is not None:
        cut = paged(rows.select("depth", "rank"), [F.asc("depth"), F.asc("rank")], spec["limit"], 1).collect()
        if cut:
            over = True
            before = F.struct("depth", "rank") < F.struct(F.lit(cut[0]["depth"]).cast("int").alias("depth"), _rank(cut[0]["rank"]).alias("rank"))
            rows, popped = rows.where(before), seen.where(before)
    deep = not popped.where((F.col("depth") >= spec["maxDepth"]) & F.col("known")).join(ways.select(F.col("from").alias("node")), "node", "left_semi").isEmpty()
    return Traversal(rows, popped.where("NOT known").select("node"), deep, over)


def _rank(value):
    """A rank as a literal: a number, or an array of strings."""
    return F.array(*[F.lit(x) for x in value]) if isinstance(value, list) else F.lit(value).cast("long")


def depth_first(starts: DataFrame, edges: DataFrame, depth: int, max_edges: int) -> DataFrame:
    """The same columns in the order of a stack, which takes the last of a node's sorted edges first."""
    spark = starts.sparkSession
    reach = levels(starts, edges, depth).select(F.col("node").alias("from"))
    found = edges.join(reach, "from", "left_semi").limit(max_edges + 1).collect()
    if len(found) > max_edges:
        raise InvalidSpec(f"more than {max_edges} edges to walk depth first")
    ways: dict[str, list] = {}
    for e in sorted(found, key=lambda e: (e["source"], e["field"], e["target"], e["kind"])):
        ways.setdefault(e["from"], []).append(e)
    stack = [(r["node"], 0, [r["node"]], None) for r in starts.orderBy("ordinal").collect()]
    seen, out = set(), []
    while stack:
        node, d, path, via = stack.pop()
        if node in seen:
            continue
        seen.add(node)
        out.append((node, d, path, via, len(out)))
        if d < depth:
            stack += [(e["to"], d + 1, [*path, e["to"]], (e["source"], e["field"], e["target"], e["kind"])) for e in ways.get(node, ())]
    rows = spark.createDataFrame(out, f"node string, depth int, path array<string>, via {_VIA}, rank long")
    return rows


def closure(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """All nodes that outbound edges reach from `roots` (node), themselves included."""
    seen = written(roots.select("node").distinct(), "closure")
    frontier = seen
    while True:
        step = frontier.select(F.col("node").alias("source")).join(edges, "source").select(F.col("target").alias("node")).distinct()
        frontier = written(step.join(seen, "node", "left_anti"), "closure")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def root_nodes(nodes: DataFrame, root: str) -> DataFrame:
    """The node `root` and all whose ids lie under it."""
    return nodes.where((F.col("node") == root) | F.col("node").startswith(f"{root}/"))
