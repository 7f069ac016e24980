"""What the operators share: written tables that cut lineage, their removal, keys of rows."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.sources.tables import importable, shared_dir, written  # noqa: F401  operators take them from here


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes the folder of a written table that no later step reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Lets go of the shuffles of finished steps: Spark deletes those whose plans the driver's collector finds unused.

    The last step's plan is found unused only once what it referred to is, in a second collection a little later.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)
    spark.sparkContext._jvm.System.gc()


def row_key(*columns) -> Column:
    """128 bits that tell rows apart by the given columns: two hashes with different seeds, as bytes."""
    halves = (F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns))
    return F.concat(*[F.unhex(F.lpad(F.hex(h), 16, "0")) for h in halves])


def spare_name(df: DataFrame, name: str) -> str:
    """`name`, or what it becomes by underscores until `df` has no such column."""
    while name in df.columns:
        name = f"{name}_"
    return name


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under names that no extra column can clash with."""
    return df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"))
