"""Filters, order and paging over whatever resolves paths to values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.scalar import Value
from loomspan.sources.tables import written


def predicate(value: Value, f: dict) -> Column:
    """One filter on one value."""
    kind = f["kind"]
    if kind == "exists":
        return value.exists()
    if kind in ("gt", "gte", "lt", "lte"):
        return value.compare(kind, f["value"])
    return getattr(value, kind)(f["value"])


def conjunction(filters: list[dict], resolve) -> Column | None:
    """All filters; None without any."""
    parts = [predicate(resolve(f["path"]), f) for f in filters]
    return reduce(lambda a, b: a & b, parts) if parts else None


#: Rows that a page may have, its offset included, to be found by a heap in each task; Spark allocates heaps by this number.
TOP_K = 100_000


def paged(df: DataFrame, order: list[Column], offset: int = 0, limit: int | None = None) -> DataFrame:
    """Sorted rows from `offset` on, at most `limit`. Without a page the order is left to whoever collects the rows."""
    if not offset and limit is None:
        return df
    if limit is not None and offset + limit <= TOP_K:
        df = df.orderBy(*order)
        return (df.offset(offset) if offset else df).limit(limit)
    return _far(df, order, offset, limit)


def _far(df: DataFrame, order: list[Column], offset: int, limit: int | None) -> DataFrame:
    """A page beyond TOP_K: a range sort written once, whose partitions' row counts say where the page starts and ends; nothing is gathered but these."""
    columns = df.columns
    place = F.monotonically_increasing_id()
    ranged = written(df.orderBy(*order).withColumns({"__part": F.shiftright(place, 33), "__place": place.bitwiseAND(F.lit((1 << 33) - 1))}), "page")
    sizes = sorted((r["__part"], r["n"]) for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect())
    before, wanted = 0, F.lit(False)
    for part, n in sizes:
        low, high = max(offset - before, 0), n if limit is None else min(offset + limit - before, n)
        if low < high:
            own = F.col("__part") == part
            wanted = wanted | (own if low == 0 and high == n else own & F.col("__place").between(low, high - 1))
        before += n
    return ranged.where(wanted).orderBy("__part", "__place").select(*columns)


def key_range(key: Column, prefix=None, start_at=None, start_after=None, end_at=None, end_before=None) -> Column:
    """All given bounds on a key, AND-ed: plain comparisons that sorted files prune by."""
    parts = [F.lit(True)]
    if prefix:
        parts.append(key.startswith(prefix))
    for bound, test in ((start_at, Column.__ge__), (start_after, Column.__gt__), (end_at, Column.__le__), (end_before, Column.__lt__)):
        if bound is not None:
            parts.append(test(key, F.lit(bound)))
    return reduce(lambda a, b: a & b, parts[1:]) if len(parts) > 1 else parts[0]
