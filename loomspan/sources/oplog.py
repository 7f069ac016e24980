"""Operation logs as JSON lines: read, stream, append, and a checkpoint of folded state beside the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import fold

_NESTED = (
    "op_id string, author string, revision struct<millis: bigint, counter: bigint, actor: string>, "
    "action struct<kind: string, node: string, field: string, member: string, value: struct<kind: string, value: string>>"
)


def flat(nested: DataFrame) -> DataFrame:
    """Wire operations as log rows; a set's value is a JSON array of ids."""
    v = F.col("action.value")
    return nested.select(
        "op_id", "author", "revision.millis", "revision.counter", "revision.actor", "action.kind", "action.node", "action.field", "action.member",
        v["kind"].alias("value_kind"), F.when(v["kind"] != "set", v["value"]).alias("value"), F.when(v["kind"] == "set", F.from_json(v["value"], "array<string>")).alias("set_members"),
    )


def nested(ops: DataFrame) -> DataFrame:
    """Log rows as wire operations."""
    text = F.when(F.col("value_kind") == "set", F.to_json("set_members")).otherwise(F.col("value"))
    value = F.when(F.col("value_kind").isNotNull(), F.struct(F.col("value_kind").alias("kind"), text.alias("value")))
    return ops.select("op_id", "author", F.struct("millis", "counter", "actor").alias("revision"), F.struct("kind", "node", "field", "member", value.alias("value")).alias("action"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return flat(spark.read.schema(_NESTED).json(path))


def stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(_NESTED)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return flat(reader.json(path))


def append(ops: DataFrame, path: str) -> None:
    nested(ops).write.mode("append").json(path)


def checkpoint(ops: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Folds a log and writes the state; returns it as read back."""
    spark = ops.sparkSession
    for name, df in zip(("fields", "members"), fold.fold(ops)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return spark.read.parquet(f"{path}/fields"), spark.read.parquet(f"{path}/members")


def compacted(ops: DataFrame, threshold: int) -> DataFrame:
    """The log, compacted if it has more rows than `threshold`."""
    return fold.compact(ops) if ops.count() > threshold else ops
