"""Canonical exact digests of texts, in DataFrame operations only.

A text's canonical form is its compatibility composition (NFKC), case-folded (upper, then lower; sharp s
as ss, final sigma as sigma), each run of white space one space, trimmed. Its fingerprint is 128 bits of xxhash, two chains with different seeds, in hex. Grouping by it
is checked: inside a bucket with more than one row the canonical bytes are compared, and if they should differ, each
form but the least gets a number after its fingerprint.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Documents in a range of ids; at most 2**16 ranges.
RANGE_ROWS = 4096
#: Parts over which the rows of one fingerprint are dealt while their forms are compared.
SALT = 8


def canonical(text: Column) -> Column:
    """Normal form of a text; null counts as empty."""
    composed = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    folded = F.replace(F.replace(F.lower(F.upper(composed)), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x85\x1C-\x1F]+", " "))


def wide_hash(form: Column) -> Column:
    """128 bits of xxhash in hex."""
    return F.concat(*(F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(form), F.xxhash64(F.lit(0x9E3779B9), form))))


def colliding(forms: DataFrame) -> DataFrame:
    """Rows (fingerprint, form, number) of buckets whose canonical forms differ: none, as a rule.

    Only buckets with more than one row are compared; a large one is dealt over SALT tasks, of which each sends on one of equal forms.
    """
    many = forms.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    dealt = forms.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int"))
    distinct = dealt.join(many, ["fingerprint", "salt"], "left_semi").select("fingerprint", "form").distinct()
    mixed = distinct.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint")
    number = F.row_number().over(Window.partitionBy("fingerprint").orderBy("form")) - 1
    return distinct.join(mixed, "fingerprint", "left_semi").withColumn("number", number)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, text, canonical `form` and checked `fingerprint` of each row; equal texts have equal fingerprints.

    Null and empty texts are the empty form. Repeated rows and null ids are kept. An empty table gives an empty result.
    Other columns are ignored.
    """
    base = docs.select(docs[id_col].alias(id_col), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("form", canonical(F.col("text"))).withColumn("fingerprint", wide_hash(F.col("form")))
    clash = shared.written(colliding(base.select("fingerprint", "form")), "collisions")
    if clash.isEmpty():
        return base
    named = F.when(F.coalesce("number", F.lit(0)) > 0, F.concat("fingerprint", F.lit("-"), "number")).otherwise(F.col("fingerprint"))
    return base.join(clash, ["fingerprint", "form"], "left").withColumn("fingerprint", named).drop("number")


def id_ranges(docs: DataFrame, id_col: str, rows: int = RANGE_ROWS) -> list[str]:
    """First ids, as text, of consecutive ranges of ids with about `rows` rows each, the first range's excluded."""
    n = docs.count()
    parts = min(-(-n // rows), 1 << 16)
    if parts < 2:
        return []
    ids = docs.select(F.col(id_col).alias("id")).where("id IS NOT NULL").repartitionByRange(parts, "id")
    firsts = ids.select(F.spark_partition_id().alias("part"), "id").groupBy("part").agg(F.min("id").cast("string").alias("id")).collect()
    return [r["id"] for r in sorted(firsts, key=lambda r: r["part"])][1:]


def range_of(value: Column, bounds: Column, n: int) -> Column:
    """Number of the range that holds an id, by binary search in the `n` bounds; null: the first."""
    steps = F.array(*[F.lit(1 << j) for j in reversed(range(n.bit_length()))])
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.try_element_at(bounds, at + s) <= value), at + s).otherwise(at)), F.lit(0))


def with_next(docs: DataFrame, id_col: str, cols: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """Adds `next_<c>` for each of `cols`: the value of the next row by ascending id (null first, ties by text); after the last: the first.

    Ids are of any type with an order and a text form: numbers, strings, dates, times. Rows are dealt into ranges of ids,
    each with a copy of the next range's first rows, so that rows are shuffled once and no task sees more than a range.
    """
    firsts = id_ranges(docs, id_col)
    last = len(firsts)
    kind = docs.schema[id_col].dataType.simpleString()
    value = F.col(id_col)
    least = docs.agg(F.min(value), F.sum(value.isNull().cast("int"))).first()
    first = value.isNull() if least[1] else value == F.lit(least[0])
    none = F.array().cast("array<struct<part:int,look:int>>")
    to = lambda part, look: F.array(F.struct(part.alias("part"), F.lit(look).alias("look")))
    part, targets = F.lit(0), to(F.lit(0), 0)
    if firsts:
        bounds = F.from_json(F.lit(json.dumps(firsts)), "array<string>").cast(f"array<{kind}>")
        part = F.col("own_range")
        # a range's first id is its bound; null and smaller ids are in the first range, which has none
        opens = F.try_element_at(bounds, F.when(part > 0, part)) == value
        targets = F.concat(to(part, 0), F.when(opens, to(part - 1, 1)).otherwise(none))
        docs = docs.withColumn("own_range", range_of(value, bounds, last))
    targets = F.concat(targets, F.when(first, to(F.lit(last), 2)).otherwise(none))
    dealt = docs.withColumn("to", F.explode(targets)).withColumn("part", F.col("to.part")).withColumn("look", F.col("to.look")).drop("to", "own_range")
    order = Window.partitionBy("part").orderBy("look", F.col(id_col).asc_nulls_first(), text_col)
    return dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in cols]).where("look = 0").drop("part", "look")


def op4(spark, sf_dir: str) -> DataFrame:
    """Contract query: fingerprints of each document and of its edited text."""
    own = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("form")
    n = F.length("text")
    rows = with_next(own, "doc_id", ("text", "fingerprint"))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - int(floor(length(text) / 4)))"), F.expr("substring(next_text, 1, int(floor(length(text) / 4)))")))
    rows = rows.withColumn("edited_fingerprint", wide_hash(canonical(F.col("edited"))))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", (F.col("fingerprint") == F.col("edited_fingerprint")).cast("double").alias("near_edited"), (F.col("fingerprint") == F.col("next_fingerprint")).cast("double").alias("near_next"))
