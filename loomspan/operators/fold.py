"""Reconstruction of state from an operation log: last writer wins, sets of adds and removes, tombstones.

An operation is a row (op_id, author, millis, counter, actor, kind, node, field, member, value_kind, value, set_members).
Its marker is (millis, counter, actor, op_id), compared in that sequence. State is the result of applying operations in
marker order, in closed form: for each (node, field) the newest assignment or deletion is the base, and what sets were
told later patches it. So no operation order, and no Python, is needed; all steps are aggregations that combine map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPS = (
    "op_id string, author string, millis bigint, counter bigint, actor string, kind string, node string, field string, member string, "
    "value_kind string, value string, set_members array<string>"
)


def marker() -> Column:
    """Version marker of a row, ordered field by field."""
    return F.struct("millis", "counter", "actor", "op_id")



def fold_fields(ops: DataFrame) -> DataFrame:
    """(node, field, value_kind, value, version) of every field that exists; a set's members are in `fold_members`."""
    base = ops.where("kind IN ('set_field', 'delete_field')").groupBy("node", "field").agg(F.max_by(F.struct("kind", "value_kind", "value"), marker()).alias("base"), F.max(marker()).alias("at"))
    told = ops.where("kind IN ('add_set_member', 'remove_set_member')").groupBy("node", "field").agg(F.max(marker()).alias("told"))
    both = base.join(told, ["node", "field"], "full")
    is_set = F.col("told").isNotNull() & (F.col("at").isNull() | (F.col("told") > F.col("at")))
    alive = is_set | (F.col("base.kind") == "set_field")
    version = F.when(is_set, F.col("told")).otherwise(F.col("at"))
    return both.where(alive).select("node", "field", F.when(is_set, "set").otherwise(F.col("base.value_kind")).alias("value_kind"), F.when(~is_set, F.col("base.value")).alias("value"), version.alias("version"))


def fold_members(ops: DataFrame) -> DataFrame:
    """(node, field, member, version) of every member of every set."""
    base = ops.where("kind IN ('set_field', 'delete_field')").groupBy("node", "field").agg(F.max_by(F.struct("kind", "value_kind", "set_members"), marker()).alias("base"), F.max(marker()).alias("at"))
    told = ops.where("kind IN ('add_set_member', 'remove_set_member')").groupBy("node", "field", "member").agg(F.max_by("kind", marker()).alias("kind"), F.max(marker()).alias("version"))
    told = told.join(base.select("node", "field", "at"), ["node", "field"], "left").where("at IS NULL OR version > at").drop("at")
    listed = base.where("base.kind = 'set_field' AND base.value_kind = 'set'").select("node", "field", F.explode(F.array_distinct("base.set_members")).alias("member"), F.col("at").alias("version"))
    every = listed.withColumn("kind", F.lit("add_set_member")).unionByName(told)
    newest = every.groupBy("node", "field", "member").agg(F.max_by("kind", "version").alias("kind"), F.max("version").alias("version"))
    return newest.where("kind = 'add_set_member'").drop("kind")


def tombstones(ops: DataFrame) -> DataFrame:
    """(node, field, version) of fields whose newest operation deleted them."""
    newest = ops.groupBy("node", "field").agg(F.max_by("kind", marker()).alias("kind"), F.max(marker()).alias("version"))
    return newest.where("kind = 'delete_field'").drop("kind")


def fold(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields and members; an operation that was delivered twice counts once (markers of copies are equal)."""
    return fold_fields(ops), fold_members(ops)


def compact(ops: DataFrame) -> DataFrame:
    """One operation per (node, field), or per (node, field, member) for set operations: the one of the newest revision.

    Equal revisions: the later in the log, by `seq`. The row keeps the place, `seq`, of its slot's first operation.
    """
    slot = ["node", "field", F.coalesce("member", F.lit(""))]
    w = Window.partitionBy(*slot)
    newest = F.row_number().over(w.orderBy(F.desc("millis"), F.desc("counter"), F.desc("actor"), F.desc("seq")))
    return ops.withColumn("place", F.min("seq").over(w)).withColumn("rank", newest).where("rank = 1").drop("rank", "seq").withColumnRenamed("place", "seq")


def merge_fields(left: DataFrame, right: DataFrame) -> DataFrame:
    """State merge of two field tables (node, field, value_kind, value, version): the newer version of each wins."""
    both = left.unionByName(right)
    return both.groupBy("node", "field").agg(F.max_by(F.struct("value_kind", "value"), "version").alias("v"), F.max("version").alias("version")).select("node", "field", "v.value_kind", "v.value", "version")


def merge_members(left: DataFrame, right: DataFrame) -> DataFrame:
    """State merge of two member tables (node, field, member, version, present): the newer word on a member wins, adds on a tie."""
    both = left.unionByName(right)
    return both.groupBy("node", "field", "member").agg(F.max_by("present", F.struct("version", "present")).alias("present"), F.max("version").alias("version"))


def authorised(ops: DataFrame, policies: DataFrame) -> DataFrame:
    """Operations that the policy of the longest scope over their node accepts.

    `policies` has (scope, mode, authority). A scope is over a node that is the scope or starts with it and a slash.
    Under mode 'coordinated' only the authority's operations count; nodes without a policy are open.
    """
    scoped = ops.select("node").distinct().withColumn("parts", F.split("node", "/"))
    scoped = scoped.withColumn("scope", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", 1, i), "/"))))
    ruled = scoped.join(policies, "scope").groupBy("node").agg(F.max_by(F.struct("mode", "authority"), F.length("scope")).alias("policy"))
    out = ops.join(ruled, "node", "left")
    accepted = F.coalesce(F.col("policy.mode") != "coordinated", F.lit(True)) | F.coalesce(F.col("policy.authority") == F.col("author"), F.lit(False))
    return out.where(accepted).drop("policy").select(*ops.columns)


def revision(ops: DataFrame) -> DataFrame:
    """(node, version): the newest marker of each node."""
    return ops.groupBy("node").agg(F.max(marker()).alias("version"))
