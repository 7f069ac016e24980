"""Keyed records: range scans with cursors, multi-get, batches with preconditions, overlays.

A record is a row (key, kind, json, bytes). Keys order by their UTF-8 bytes. Tables sorted by key prune row groups by
the plain range predicates used here.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.errors import InvalidSpec, TransactionConflict
from loomspan.operators.predicates import key_range, paged
from loomspan.plans import specs


def matching(records: DataFrame, spec: dict | None) -> DataFrame:
    """Rows in the scan's range and beyond its cursor, unordered."""
    spec = specs.filled(spec, specs.RECORD_SCAN)
    return records.where(_bounds(records["key"], spec))


def scan(records: DataFrame, spec: dict | None = None) -> DataFrame:
    """The page of a scan, ordered by key."""
    spec = specs.filled(spec, specs.RECORD_SCAN)
    rows = matching(records, spec)
    order = F.desc("key") if spec["reverse"] else F.asc("key")
    return rows.orderBy(order) if spec["limit"] is None else paged(rows, [order], 0, spec["limit"])


def next_cursor(records: DataFrame, spec: dict) -> str | None:
    """Where the page after this one starts, if rows remain: the page's last key, or the first key behind an empty page."""
    spec = specs.filled(spec, specs.RECORD_SCAN)
    if spec["limit"] is None:
        return None
    rows = matching(records, spec).select("key")
    if rows.count() <= spec["limit"]:
        return None
    order = F.desc("key") if spec["reverse"] else F.asc("key")
    return paged(rows, [order], max(spec["limit"] - 1, 0), 1).first()["key"]


def get(records: DataFrame, key: str) -> DataFrame:
    return records.where(F.col("key") == key)


def get_many(records: DataFrame, keys: list[str]) -> DataFrame:
    """A row (ordinal, key, ...) for each asked key, in the order asked and as often; nulls where there is no record."""
    asked = records.sparkSession.createDataFrame([(i, k) for i, k in enumerate(keys)], "ordinal int, key string")
    return asked.join(records, "key", "left").select("ordinal", *records.columns)


def overlay(base: DataFrame, over: DataFrame) -> DataFrame:
    """`base` with the rows of `over` put in; a row of `over` whose `deleted` is true takes its key away."""
    kept = base.join(over.select("key"), "key", "left_anti")
    return kept.unionByName(over.where("NOT deleted").select(*base.columns))


def _checked(records: DataFrame, preconditions: Iterable[dict]) -> None:
    wanted = list(preconditions)
    keys = sorted({p["key"] for p in wanted})
    found = {r["key"]: r for r in records.where(F.col("key").isin(keys)).collect()} if keys else {}
    for p in wanted:
        row = found.get(p["key"])
        if p["kind"] == "exists":
            ok = row is not None
        elif p["kind"] == "absent":
            ok = row is None
        elif p["kind"] == "value":
            ok = row is not None and row["json"] == p["value"]
        else:
            raise InvalidSpec(f"not a precondition: {p}")
        if not ok:
            raise TransactionConflict(f"{p['kind']} {p['key']}")


def apply_batch(records: DataFrame, batch: dict) -> tuple[DataFrame, dict[str, int]]:
    """The table after a batch, all or nothing, and a report of puts, deletes and rows that range deletes met.

    Mutations apply in sequence; what a later one says about a key stands. The batch is reduced first, to the last word
    on each of its keys and to ranges: the plan has one filter and one union, however many mutations there are. How many
    rows the deletes met is counted in one pass over the rows they touch.
    """
    spark = records.sparkSession
    _checked(records, batch.get("preconditions", []))
    mutations = list(batch.get("mutations", []))
    if bad := [m for m in mutations if m["kind"] not in ("put", "delete", "delete_range")]:
        raise InvalidSpec(f"not a mutation: {bad[0]}")
    ranges = [(i, specs.filled(m["range"], specs.RECORD_SCAN)) for i, m in enumerate(mutations) if m["kind"] == "delete_range"]
    named = sorted({m["key"] for m in mutations if m["kind"] != "delete_range"})
    # rows of the table that a range meets, but for keys that the batch names: the first range that holds them takes them
    plain = records.where(~F.col("key").isin(named)) if named else records
    in_any = F.lit(False)
    for _, spec in ranges:
        in_any = in_any | _bounds(F.col("key"), spec)
    met = plain.where(in_any).count() if ranges else 0
    report = {"puts": sum(m["kind"] == "put" for m in mutations), "deletes": met, "range_deletes": met}
    there = {r["key"] for r in records.where(F.col("key").isin(named)).select("key").collect()} if named else set()
    last: dict[str, dict] = {}
    for m in mutations:
        if m["kind"] == "delete_range":
            spec = specs.filled(m["range"], specs.RECORD_SCAN)
            hit = [k for k in named if k in there and _holds(k, spec)]
            report["deletes"] += len(hit)
            report["range_deletes"] += len(hit)
            there -= set(hit)
            for k in hit:
                last.pop(k, None)
        elif m["kind"] == "put":
            there.add(m["key"])
            last[m["key"]] = m
        else:
            report["deletes"] += m["key"] in there
            there.discard(m["key"])
            last.pop(m["key"], None)
    kept = plain.where(~in_any) if ranges else plain
    untouched = sorted(there - set(last))
    rows = [(k, m.get("kind_of", "json"), m.get("value"), m.get("bytes")) for k, m in sorted(last.items())]
    put = spark.createDataFrame(rows, "key string, kind string, json string, bytes binary").select(*records.columns)
    return kept.unionByName(records.where(F.col("key").isin(untouched))).unionByName(put), report


def _bounds(key: Column, spec: dict) -> Column:
    """The range of a scan and what lies behind its cursor."""
    inside = key_range(key, spec["prefix"], spec["startAt"], spec["startAfter"], spec["endAt"], spec["endBefore"])
    if spec["cursor"] is not None:
        inside = inside & (key < spec["cursor"] if spec["reverse"] else key > spec["cursor"])
    return inside


def _holds(key: str, spec: dict) -> bool:
    """The same for one key; strings compare by their UTF-8 bytes."""
    code = lambda s: s.encode()
    tests = (("startAt", bytes.__ge__), ("startAfter", bytes.__gt__), ("endAt", bytes.__le__), ("endBefore", bytes.__lt__), ("cursor", bytes.__lt__ if spec["reverse"] else bytes.__gt__))
    return key.startswith(spec["prefix"] or "") and all(spec[k] is None or test(code(key), code(spec[k])) for k, test in tests)


def delete_range(records: DataFrame, spec: dict) -> DataFrame:
    """The table without the range's rows: the complement predicate, without a join."""
    spec = specs.filled(spec, specs.RECORD_SCAN)
    return records.where(~key_range(records["key"], spec["prefix"], spec["startAt"], spec["startAfter"], spec["endAt"], spec["endBefore"]))
