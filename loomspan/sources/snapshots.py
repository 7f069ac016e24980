"""State as directories of Parquet tables, graph JSON, blobs, vacuum."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.errors import BlobNotFound
from loomspan.operators.graph import Graph


def save(graph: Graph, path: str) -> str:
    """Writes a new version of the state under `path` and then the row that names it, the last step of the commit."""
    version = uuid.uuid4().hex
    graph.fields.sortWithinPartitions("node", "field").write.parquet(f"{path}/versions/{version}/fields")
    graph.members.sortWithinPartitions("node", "field", "member").write.parquet(f"{path}/versions/{version}/members")
    graph.nodes.write.parquet(f"{path}/versions/{version}/nodes")
    graph.spark.createDataFrame([(version,)], "version string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return version


def load(spark: SparkSession, path: str) -> Graph:
    """The newest committed version."""
    version = spark.read.parquet(f"{path}/commits").orderBy(F.desc("at"), "version").first()["version"]
    return Graph(*(spark.read.parquet(f"{path}/versions/{version}/{t}") for t in ("fields", "members", "nodes")))


def for_root(graph: Graph, root: str) -> Graph:
    """The nodes under a root and all they reach."""
    return graph.closure(root)


def export_graph_json(graph: Graph, nodes: DataFrame | None = None) -> DataFrame:
    """(node, json): a node's metadata object `_` and its fields; links as {"#": id}, sets as objects of links."""
    own = graph.fields if nodes is None else graph.fields.join(nodes, "node", "left_semi")
    held = graph.members if nodes is None else graph.members.join(nodes, "node", "left_semi")
    quoted = lambda c: F.substring(F.to_json(F.struct(F.col(c).alias("x"))), F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("x")))) - 6)
    text = F.when(F.col("kind") == "link", F.concat(F.lit('{"#":'), quoted("value"), F.lit("}"))).when(F.col("kind") == "bytes", F.concat(F.lit('{"$bytes":'), quoted("value"), F.lit("}"))).otherwise(F.col("value"))
    pairs = own.where("kind <> 'set'").select("node", "field", F.concat(quoted("field"), F.lit(":"), text).alias("pair"))
    member = held.select("node", "field", "member", F.concat(quoted("member"), F.lit(':{"#":'), quoted("member"), F.lit("}")).alias("m"))
    sets = member.groupBy("node", "field").agg(F.sort_array(F.collect_list("m")).alias("ms")).select("node", "field", F.concat(quoted("field"), F.lit(":{"), F.array_join("ms", ","), F.lit("}")).alias("pair"))
    made = pairs.unionByName(sets).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("field", "pair"))).alias("pairs"))
    head = F.concat(F.lit('"_":{"#":'), quoted("node"), F.lit("}"))
    return made.select("node", F.concat(F.lit("{"), F.array_join(F.concat(F.array(head), F.transform("pairs", lambda p: p["pair"])), ","), F.lit("}")).alias("json"))


def import_graph_json(rows: DataFrame) -> Graph:
    """State from (node, json) rows of `export_graph_json`; an object of links comes back as a set, numbers as whole or decimal."""
    values = rows.select("node", F.explode(F.from_json("json", "map<string,string>")).alias("field", "text")).where("field <> '_'")
    whole = rows.select(F.col("node").alias("n"), F.try_parse_json("json").alias("v"))
    raw = values.join(whole, values["node"] == whole["n"]).withColumn("entry", F.from_json(F.to_json("v"), "map<string,variant>")[F.col("field")])
    shape = F.schema_of_variant("entry")
    link = F.try_variant_get("entry", "$['#']", "string")
    is_set = shape.startswith("OBJECT") & link.isNull() & ~shape.contains("$bytes")
    kind = F.when(link.isNotNull(), "link").when(is_set, "set").when(shape.contains("$bytes"), "bytes").otherwise("scalar")
    value = F.when(kind == "link", link).when(kind == "bytes", F.try_variant_get("entry", "$['$bytes']", "string")).when(kind == "scalar", F.to_json("entry"))
    fields = raw.select("node", "field", kind.alias("kind"), value.alias("value"))
    members = raw.where(is_set).select("node", "field", F.explode(F.map_keys(F.from_json(F.to_json("entry"), "map<string,variant>"))).alias("member"))
    return Graph(fields, members, rows.select("node"))


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """(id, bytes, data) of the files in a folder; the id is the content's SHA-256."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.sha2("content", 256).alias("id"), F.col("length").alias("bytes"), F.col("content").alias("data")).dropDuplicates(["id"])


def blob(store: DataFrame, blob_id: str) -> bytes:
    row = store.where(F.col("id") == blob_id).first()
    if row is None:
        raise BlobNotFound(blob_id)
    return bytes(row["data"])


def live_blobs(store: DataFrame, graph: Graph) -> tuple[DataFrame, DataFrame]:
    """(kept, garbage): blobs that a field refers to, and those that none does."""
    used = graph.fields.where("kind = 'blob'").select(F.get_json_object("value", "$.id").alias("id")).distinct()
    return store.join(used, "id", "left_semi"), store.join(used, "id", "left_anti")


def vacuum(graph: Graph, roots: DataFrame) -> tuple[Graph, DataFrame]:
    """The state that `roots` (node) reach, and a one-row report of nodes and fields left out."""
    from loomspan.operators.traverse import closure

    kept = closure(roots, graph.edges())
    out = Graph(graph.fields.join(kept, "node", "left_semi"), graph.members.join(kept, "node", "left_semi"), graph.nodes.join(kept, "node", "left_semi"))
    gone = graph.nodes.join(kept, "node", "left_anti").agg(F.count("*").alias("nodes")).crossJoin(graph.fields.join(kept, "node", "left_anti").agg(F.count("*").alias("fields")))
    return out, gone


def redacted(rows: DataFrame, hide: dict[str, str], deny=None) -> DataFrame:
    """A served result after its hook: denied rows left out, columns replaced by fixed text."""
    if deny is not None:
        rows = rows.where(~deny)
    return rows.withColumns({c: F.lit(v) for c, v in hide.items()})
