"""What message routing computes, as relations: duplicate suppression, targets, forwarding, presence, peer choice, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deduplicated(routes: DataFrame, own_id: str | None = None) -> DataFrame:
    """Routes not seen before: one of each route id, and one of each (sender, reply_to, content_hash); none that passed `own_id`."""
    if own_id is not None:
        routes = routes.where(~F.array_contains("seen_by", own_id))
    first = routes.groupBy("route_id").agg(F.min_by(F.struct(*routes.columns), "ordinal").alias("r")).select("r.*")
    same = ["sender", "reply_to", "content_hash"]
    return first.groupBy(*same).agg(F.min_by(F.struct(*routes.columns), "ordinal").alias("r")).select("r.*")


def for_target(routes: DataFrame, peer: str, topics: list[str], channel: str) -> DataFrame:
    """Broadcasts on the channel, routes to the peer, and routes to a topic it has."""
    kind, target = F.col("target_kind"), F.col("target")
    return routes.where(((kind == "broadcast") & (F.col("channel") == channel)) | ((kind == "peer") & (target == peer)) | ((kind == "topic") & target.isin(topics)))


def forwarded(routes: DataFrame, own_id: str) -> DataFrame:
    """Routes to pass on: one hop less to live, this peer among those that saw them."""
    return routes.where("ttl > 1").withColumns({"ttl": F.col("ttl") - 1, "seen_by": F.array_append("seen_by", F.lit(own_id))})


def presence(events: DataFrame) -> DataFrame:
    """The newest state of each peer that isn't offline."""
    return events.groupBy("peer").agg(F.max_by("state", "millis").alias("state"), F.max("millis").alias("millis")).where("state <> 'offline'")


def recommendation(capabilities: Column, topics: Column) -> Column:
    """50, 10 for each capability and 5 for each topic, 8 of either at most."""
    return F.lit(50) + 10 * F.least(F.size(capabilities), F.lit(8)) + 5 * F.least(F.size(topics), F.lit(8))


def recipients(routes: DataFrame, sessions: DataFrame) -> DataFrame:
    """(route_id, session) of the sessions on a route's channel but the sender's."""
    return routes.join(sessions, "channel").where(F.col("session_peer") != F.col("sender")).select("route_id", "session")


def app_messages(messages: DataFrame, **equal: str | None) -> DataFrame:
    """Messages with the given namespace, protocol and topic, as far as given."""
    for name, value in equal.items():
        if value is not None:
            messages = messages.where(F.col(name) == value)
    return messages


def assembled(chunks: DataFrame) -> DataFrame:
    """(stream, payload) of the streams whose chunks 1 to the final one are all there; the first of each sequence number counts."""
    first = chunks.groupBy("stream", "seq").agg(F.min_by("chunk", "ordinal").alias("chunk"), F.bool_or("final").alias("final"))
    whole = first.groupBy("stream").agg(F.max(F.when(F.col("final"), F.col("seq"))).alias("last"), F.sort_array(F.collect_list(F.struct("seq", "chunk"))).alias("parts"))
    upto = F.filter("parts", lambda p: p["seq"] <= F.col("last"))
    return whole.where(F.size(upto) == F.col("last")).select("stream", F.array_join(F.transform(upto, lambda p: p["chunk"]), "").alias("payload"))


def underlays(paths: DataFrame, allowed: list[str], preferred: str) -> DataFrame:
    """Usable transports: direct ones first, then the preferred one, then by priority and id."""
    return paths.where(F.col("transport").isin(allowed)).orderBy(F.desc("direct"), F.desc(F.col("transport") == preferred), "priority", "id")


def chosen_peers(peers: DataFrame, explicit: list[str] | None = None, capability: str | None = None, collection: str | None = None, kind: str = "text") -> DataFrame:
    """Peers for a request: the named ones or all, those with a capability, best collection hint first (2 this one, 1 another, 0 none)."""
    if explicit is not None:
        peers = peers.where(F.col("peer").isin(explicit))
    if capability is not None:
        peers = peers.where(F.array_contains("capabilities", capability))
    score = F.lit(0)
    if collection is not None:
        prefix = f"{kind}_collection:"
        score = F.when(F.array_contains("capabilities", prefix + collection), 2).when(F.exists("capabilities", lambda c: c.startswith(prefix)), 1).otherwise(0)
    return peers.withColumn("hint", score).orderBy(F.desc("hint"), "peer")


def batches(items: DataFrame, key: str, most: int = 32) -> DataFrame:
    """Items with `batch`: at most `most` of one route together, in order."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy(key).orderBy("ordinal")) - 1
    return items.withColumn("batch", F.floor(at / most))


def accepted(ops: DataFrame, grants: DataFrame) -> DataFrame:
    """Operations whose author holds a grant on a prefix of their node, once each."""
    ok = ops.join(grants.withColumnRenamed("author", "__author"), (F.col("author") == F.col("__author")) & F.col("node").startswith(F.col("prefix")), "left_semi")
    return ok
