"""The driver's tables as the engine sees them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators.graph import Graph
from loomspan.operators.tables import Table, TableGraph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> TableGraph:
    """The star schema as a table graph; all its tables, or the given ones."""
    made = {
        "region": ("r_regionkey", {}),
        "nation": ("n_nationkey", {"region": ("n_regionkey", "region")}),
        "customer": ("c_custkey", {"nation": ("c_nationkey", "nation")}),
        "supplier": ("s_suppkey", {"nation": ("s_nationkey", "nation")}),
        "part": ("p_partkey", {}),
        "orders": ("o_orderkey", {"customer": ("o_custkey", "customer")}),
    }
    return TableGraph(*[Table(n, read(spark, sf_dir, n), *made[n]) for n in names or made])


def world(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations and regions as versionless state: a root `world` with the sets `nations` and `regions`."""
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")

    def field(df: DataFrame, node, name: str, kind: str, value) -> DataFrame:
        return df.select(node.alias("node"), F.lit(name).alias("field"), F.lit(kind).alias("kind"), value.alias("value"))

    r, n = F.concat(F.lit("region/"), F.col("r_regionkey")), F.concat(F.lit("nation/"), F.col("n_nationkey"))
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    fields = field(region, r, "name", "scalar", quoted("r_name")).unionByName(field(region, r, "rank", "scalar", F.col("r_regionkey").cast("string")))
    fields = fields.unionByName(field(nation, n, "name", "scalar", quoted("n_name"))).unionByName(field(nation, n, "rank", "scalar", F.col("n_nationkey").cast("string")))
    fields = fields.unionByName(field(nation, n, "region", "link", F.concat(F.lit("region/"), F.col("n_regionkey"))))
    members = nation.select(F.lit("world").alias("node"), F.lit("nations").alias("field"), n.alias("member"))
    members = members.unionByName(region.select(F.lit("world").alias("node"), F.lit("regions").alias("field"), r.alias("member")))
    return Graph(fields, members)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as keyed records `events/<padded id>`."""
    events = read(spark, sf_dir, "events")
    key = F.concat(F.lit("events/"), F.lpad(F.col("event_id").cast("string"), 10, "0"))
    return events.select(key.alias("key"), F.lit("json").alias("kind"), F.col("props").alias("json"), F.lit(None).cast("binary").alias("bytes"))


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an operation log: each sets the field of its type on its user's node."""
    events = read(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").cast("string").alias("op_id"), F.concat(F.lit("actor"), F.pmod("user_id", F.lit(3))).alias("author"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("millis"), F.lit(0).cast("long").alias("counter"), F.lit("log").alias("actor"),
        F.lit("set_field").alias("kind"), F.concat(F.lit("user/"), F.col("user_id")).alias("node"), F.col("event_type").alias("field"), F.lit(None).cast("string").alias("member"),
        F.lit("scalar").alias("value_kind"), F.col("value").cast("string").alias("value"), F.lit(None).cast("array<string>").alias("set_members"),
    )
