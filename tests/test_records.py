"""Keyed records: ranges, cursors, batches, overlays."""

import pytest
from pyspark.sql import functions as F

from loomspan.errors import InvalidSpec, TransactionConflict
from loomspan.operators import records


@pytest.fixture(scope="module")
def store(spark):
    rows = [(k, "json", f'"{k}"', None) for k in ("inode/1", "dentry/1/README", "chunk/2/000000", "chunk/2/000001", "chunk/3/000000")]
    return spark.createDataFrame(rows, "key string, kind string, json string, bytes binary")


def keys(df):
    return [r["key"] for r in df.collect()]


def test_ranges(store):
    assert keys(records.scan(store, {"prefix": "chunk/2/"})) == ["chunk/2/000000", "chunk/2/000001"]
    assert keys(records.scan(store, {"startAfter": "chunk/2/000000", "endBefore": "dentry/1/README"})) == ["chunk/2/000001", "chunk/3/000000"]
    assert keys(records.scan(store, {"startAt": "chunk/2/000001", "endAt": "dentry/1/README", "reverse": True})) == ["dentry/1/README", "chunk/3/000000", "chunk/2/000001"]
    assert keys(records.scan(store, {"limit": 0})) == []
    with pytest.raises(InvalidSpec):
        records.scan(store, {"start": "x"})


@pytest.mark.parametrize("reverse", [False, True])
def test_pages_cover_all(store, reverse):
    cursor, got = None, []
    while True:
        spec = {"limit": 2, "cursor": cursor, "reverse": reverse}
        got += keys(records.scan(store, spec))
        cursor = records.next_cursor(store, spec)
        if cursor is None:
            break
    assert got == sorted(got, reverse=reverse) and len(got) == 5
    assert records.next_cursor(store, {"limit": 0}) == "chunk/2/000000"


def test_multi_get(store):
    rows = records.get_many(store, ["inode/1", "none", "inode/1"]).orderBy("ordinal").collect()
    assert [r["json"] for r in rows] == ['"inode/1"', None, '"inode/1"'] and records.get(store, "none").isEmpty()


def test_batches(store):
    out, report = records.apply_batch(store, {"preconditions": [{"kind": "absent", "key": "x"}, {"kind": "value", "key": "inode/1", "value": '"inode/1"'}], "mutations": [
        {"kind": "put", "key": "x", "value": "1"}, {"kind": "delete", "key": "inode/1"}, {"kind": "delete", "key": "none"}, {"kind": "delete_range", "range": {"prefix": "chunk/2/"}}]})
    assert sorted(keys(out)) == ["chunk/3/000000", "dentry/1/README", "x"]
    assert report == {"puts": 1, "deletes": 3, "range_deletes": 2}
    with pytest.raises(TransactionConflict):
        records.apply_batch(store, {"preconditions": [{"kind": "exists", "key": "none"}]})


def test_overlay_and_range_delete(spark, store):
    over = spark.createDataFrame([("inode/1", "json", "2", None, False), ("chunk/3/000000", "json", None, None, True), ("new", "json", "3", None, False)], "key string, kind string, json string, bytes binary, deleted boolean")
    got = {r["key"]: r["json"] for r in records.overlay(store, over).collect()}
    assert got["inode/1"] == "2" and got["new"] == "3" and "chunk/3/000000" not in got and len(got) == 5
    assert records.delete_range(store, {"prefix": "chunk/"}).where(F.col("key").startswith("chunk")).isEmpty()
