"""From raw documents to packed sequences: five stages, each working on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import decontaminate, near, packing, quality, shared, substring


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling draws; labelled rows of the table `labels` show what is good."""
    shared.importable(spark)
    return quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), scores=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each group of near copies; of a repeated row one."""
    shared.importable(spark)
    name, key = shared.spare_name(docs, "__row_key"), shared.row_key(docs["doc_id"], docs["text"].cast("string"))
    firsts = near.near_duplicates(docs).where("row_key = class_key").select(F.col("row_key").alias(name)).distinct()
    return docs.withColumn(name, key).join(firsts, name, "left_semi").dropDuplicates([name]).drop(name)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the word sequences that occur more than once; those that had nothing else are gone."""
    shared.importable(spark)
    names = docs.columns
    inner = docs.toDF(*[f"__{i}" for i in range(len(names))])  # no extra column clashes with what the operator returns
    own = {c: f"__{i}" for i, c in enumerate(names)}
    rest = tuple(own[c] for c in names if c not in ("doc_id", "text"))
    out = substring.remove_repeats(inner, id_col=own["doc_id"], text_col=own["text"], carry=rest).where("NOT (n_removed > 0 AND kept = '')")
    columns = {c: F.col(k) for c, k in own.items()} | {"text": F.col("kept")}
    if "n_chars" in names:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.select(*[columns[c].alias(c) for c in names])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    shared.importable(spark)
    name, key = shared.spare_name(docs, "__row_key"), shared.row_key(docs["doc_id"], docs["text"].cast("string"))
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit > 0")
    return docs.withColumn(name, key).join(found.select(F.col("row_key").alias(name)).distinct(), name, "left_anti").drop(name)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens."""
    shared.importable(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: A fitted classifier, connected components and a tokenizer are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each one's result written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared.written(docs, f"stage{i}")
    return docs
