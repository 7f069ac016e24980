"""Answers of several peers merged into one, with conflicts reported."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(*columns: str) -> Column:
    """A hash of a row's content, the same for equal content on any peer."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def union(answers: dict[str, DataFrame], transport: str = "local") -> DataFrame:
    """All peers' rows with `peer` and `transport`."""
    return reduce(DataFrame.unionByName, [df.withColumns({"peer": F.lit(p), "transport": F.lit(transport)}) for p, df in sorted(answers.items())])


def _ranked(rows: DataFrame, key: str) -> DataFrame:
    content = [c for c in rows.columns if c not in (key, "peer", "transport")]
    return rows.withColumn("hash", content_hash(*content))


def merge_records(rows: DataFrame, key: str = "key") -> DataFrame:
    """One row per key: the one of the least (peer, hash, transport), with the number of peers and of different contents.

    An aggregate with a minimum by struct, so rows of a key combine before they are shuffled.
    """
    ranked = _ranked(rows, key)
    content = [c for c in rows.columns if c != key]
    best = F.min_by(F.struct(*content), F.struct("peer", "hash", "transport"))
    return ranked.groupBy(key).agg(best.alias("w"), F.countDistinct("peer").alias("peers"), F.countDistinct("hash").alias("versions")).select(key, "w.*", "peers", "versions")


def conflicts(rows: DataFrame, key: str = "key") -> DataFrame:
    """Keys whose content differs between answers: key, the winner's peer, all peers in order."""
    ranked = _ranked(rows, key)
    out = ranked.groupBy(key).agg(F.min_by("peer", F.struct("peer", "hash", "transport")).alias("winner"), F.sort_array(F.collect_set("peer")).alias("peers"), F.countDistinct("hash").alias("versions"))
    return out.where("versions > 1")


def cursors(by_peer: dict[str, str | None]) -> str | None:
    """One cursor for all peers: a JSON object of those that have more."""
    more = {p: c for p, c in by_peer.items() if c is not None}
    return json.dumps(more, sort_keys=True) if more else None


def failures(spark, by_peer: dict[str, str]) -> DataFrame:
    """A row for each peer that didn't answer."""
    return spark.createDataFrame(sorted(by_peer.items()), "peer string, error string")


def merge_text(rows: DataFrame) -> DataFrame:
    """All matches by falling score, ties by id: neither cut again nor freed of repeated ids."""
    return rows.orderBy(F.desc("score"), "id", "peer")


def merge_counts(counts: DataFrame) -> DataFrame:
    """One row: sums of candidates and of what was searched, and whether any peer cut its candidates."""
    return counts.agg(F.sum("candidate_count").alias("candidate_count"), F.sum("searched_count").alias("searched_count"), F.coalesce(F.bool_or("truncated_candidates"), F.lit(False)).alias("truncated_candidates"), F.lit("peer_local").alias("scope"))


def winner_by_window(rows: DataFrame, key: str = "key") -> DataFrame:
    """`merge_records` by a window, for content that can't be put in a struct; a key's rows meet in one task."""
    ranked = _ranked(rows, key)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("peer", "hash", "transport"))
    return ranked.withColumn("rank", rank).where("rank = 1").drop("rank", "hash")
