"""Stored indexes: tables derived from a source, kept in a folder with the source's fingerprint, so that staleness is seen."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.errors import StaleIndex


def fingerprint(source: DataFrame) -> str:
    """Row count and a sum of row hashes: the same for the same rows in any order, and nothing is gathered."""
    kinds = dict(source.dtypes)
    columns = [F.map_entries(c) if kinds[c].startswith("map") else F.col(c) for c in sorted(source.columns)]
    row = source.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}:{row['h']}"


def build(source: DataFrame, path: str, tables: Callable[[DataFrame], dict[str, tuple[DataFrame, str]]]) -> None:
    """Writes a new version: each table range-sorted by its column, so that look-ups skip row groups; the row that names the version comes last."""
    spark, version = source.sparkSession, uuid.uuid4().hex
    for name, (df, by) in tables(source).items():
        df.repartitionByRange(F.col(by)).sortWithinPartitions(by).write.parquet(f"{path}/versions/{version}/{name}")
    spark.createDataFrame([(version, fingerprint(source))], "version string, source string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def opened(source: DataFrame, path: str, tables: Callable, policy: str = "refresh") -> Callable[[str], DataFrame] | None:
    """name -> table of the newest version. A stale or missing one is rebuilt (refresh), taken as it is (allow, allow_stale), refused (reject, error), or not used (fallback_exact: None)."""
    spark = source.sparkSession
    newest = None
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    if fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
        newest = spark.read.parquet(f"{path}/commits").orderBy(F.desc("at"), "version").first()
    fresh = newest is not None and (policy in ("allow", "allow_stale") or newest["source"] == fingerprint(source))
    if not fresh:
        if policy in ("reject", "error"):
            raise StaleIndex(path)
        if policy == "fallback_exact" or (policy == "allow_stale" and newest is None):
            return None
        build(source, path, tables)
        return opened(source, path, tables, "allow")
    return lambda name: spark.read.parquet(f"{path}/versions/{newest['version']}/{name}")
