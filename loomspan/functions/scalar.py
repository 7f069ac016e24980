"""Values as JSON compares them, over native columns and over JSON text.

Comparison is typed: a number meets numbers, a string strings; across types nothing matches. Absence is not null: a JSON
null is a value that exists. Equality minds the form of a number (1 is not 1.0), order doesn't.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Order of types where one column holds several: as in an order-preserving key.
TYPE_RANK = {"bool": 0, "int": 1, "float": 1, "string": 2, "null": 3, "array": 4, "object": 5}


def tag_of(value) -> str:
    """JSON type of a Python value."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, (list, tuple)) else "object"


def canonical(value) -> str:
    """JSON text with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


class Value:
    """What a path yields: predicates that are false where it is absent, and order columns."""

    def eq(self, other) -> Column:
        raise NotImplementedError

    def compare(self, op: str, other) -> Column:
        raise NotImplementedError

    def exists(self) -> Column:
        raise NotImplementedError

    def text(self) -> Column | None:
        """The string, null for other types; None if the value is never a string."""
        raise NotImplementedError

    def order(self, descending: bool) -> list[Column]:
        raise NotImplementedError

    def ne(self, other) -> Column:
        return self.exists() & ~self.eq(other)

    def prefix(self, text: str) -> Column:
        own = self.text()
        return F.lit(False) if own is None else F.coalesce(own.startswith(text), F.lit(False))

    def contains(self, text: str) -> Column:
        own = self.text()
        return F.lit(False) if own is None else F.coalesce(own.contains(text), F.lit(False))


_OPS = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}


class Native(Value):
    """A column of one type; SQL null is absence. Plain comparisons, so that filters reach the scan."""

    def __init__(self, column: Column, kind: T.DataType):
        self.column, self.kind = column, kind
        if isinstance(kind, T.StringType):
            self.tag = "string"
        elif isinstance(kind, T.BooleanType):
            self.tag = "bool"
        elif isinstance(kind, T.IntegralType):
            self.tag = "int"
        elif isinstance(kind, T.NumericType):
            self.tag = "float"
        else:
            self.tag = "other"

    def _plain(self, other) -> Column:
        """Comparisons with null are null; a filter drops them, so scans still see them as they are."""
        return self.column == F.lit(other)

    def eq(self, other) -> Column:
        if self.tag == "other":
            return F.coalesce(self.column.cast("string") == F.lit(other if isinstance(other, str) else canonical(other)), F.lit(False))
        return self._plain(other) if tag_of(other) == self.tag else F.lit(False)

    def ne(self, other) -> Column:
        return self.column != F.lit(other) if tag_of(other) == self.tag else self.exists()

    def compare(self, op: str, other) -> Column:
        tag = tag_of(other)
        if TYPE_RANK.get(tag) != TYPE_RANK.get(self.tag, -1) or tag in ("array", "object", "null"):
            return F.lit(False)
        return _OPS[op](self.column, F.lit(other))

    def exists(self) -> Column:
        return self.column.isNotNull()

    def text(self) -> Column | None:
        return self.column if self.tag == "string" else None

    def prefix(self, text: str) -> Column:
        return self.column.startswith(text) if self.tag == "string" else F.lit(False)

    def contains(self, text: str) -> Column:
        return self.column.contains(text) if self.tag == "string" else F.lit(False)

    def order(self, descending: bool) -> list[Column]:
        return [self.column.desc_nulls_last() if descending else self.column.asc_nulls_first()]


def _tag(raw: Column) -> Column:
    return (
        F.when(raw == "null", "null").when(raw.isin("true", "false"), "bool").when(raw.startswith('"'), "string").when(raw.startswith("["), "array").when(raw.startswith("{"), "object")
        .when(raw.rlike(r"^-?\d+$"), "int").when(raw.isNotNull(), "float")
    )


def _number(raw: Column) -> Column:
    return F.when(raw.rlike(r"^-?\d"), raw.try_cast("double"))


def _string(raw: Column) -> Column:
    return F.when(raw.startswith('"'), F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>")[0])


def _whole(raw: Column) -> Column:
    return F.when(raw.rlike(r"^[\[{]"), F.to_json(F.try_parse_json(raw))).otherwise(raw)


def typed(raw: Column) -> Column:
    """JSON text as a comparable struct (tag, rank, n, s, b, raw); null text gives a null struct, which is absence."""
    tag = _tag(raw)
    rank = reduce(lambda acc, kv: acc.when(tag == kv[0], kv[1]), TYPE_RANK.items(), F)
    parts = [tag.alias("tag"), rank.alias("rank"), _number(raw).alias("n"), _string(raw).alias("s"), (raw == "true").alias("b"), _whole(raw).alias("raw")]
    return F.when(raw.isNotNull(), F.struct(*parts))


class JsonText(Value):
    """JSON text, compared without building the whole struct: each predicate evaluates what it needs."""

    def __init__(self, raw: Column):
        self.raw = raw

    @property
    def v(self) -> Column:
        """The struct, to sort by."""
        return typed(self.raw)

    def exists(self) -> Column:
        return self.raw.isNotNull()

    def text(self) -> Column:
        return _string(self.raw)

    def eq(self, other) -> Column:
        tag = tag_of(other)
        if tag == "string":
            same = _string(self.raw) == other
        elif tag == "float":
            same = (_number(self.raw) == other) & ~self.raw.rlike(r"^-?\d+$")
        else:
            same = (_whole(self.raw) if tag in ("array", "object") else self.raw) == canonical(other)
        return F.coalesce(same, F.lit(False))

    def compare(self, op: str, other) -> Column:
        tag = tag_of(other)
        if tag in ("array", "object"):
            return F.lit(False)
        if tag == "null":
            return F.coalesce(self.raw == "null", F.lit(False)) if op in ("gte", "lte") else F.lit(False)
        if tag == "bool":
            mine = F.when(self.raw.isin("true", "false"), self.raw == "true")
        else:
            mine = _string(self.raw) if tag == "string" else _number(self.raw)
        return F.coalesce(_OPS[op](mine, F.lit(other)), F.lit(False))

    def order(self, descending: bool) -> list[Column]:
        return Json(self.v).order(descending)


class Json(Value):
    """A struct made by `typed`."""

    def __init__(self, struct: Column):
        self.v = struct

    def exists(self) -> Column:
        return self.v.isNotNull()

    def text(self) -> Column:
        return self.v["s"]

    def eq(self, other) -> Column:
        tag = tag_of(other)
        same = {"float": lambda: self.v["n"] == other, "string": lambda: self.v["s"] == other}.get(tag, lambda: self.v["raw"] == canonical(other))()
        return F.coalesce((self.v["tag"] == tag) & same, F.lit(False))

    def compare(self, op: str, other) -> Column:
        tag = tag_of(other)
        if tag in ("array", "object"):
            return F.lit(False)
        if tag == "null":
            return F.coalesce(self.v["tag"] == "null", F.lit(False)) if op in ("gte", "lte") else F.lit(False)
        mine = {"bool": "b", "string": "s"}.get(tag, "n")
        return F.coalesce((self.v["rank"] == TYPE_RANK[tag]) & _OPS[op](self.v[mine], F.lit(other)), F.lit(False))

    def order(self, descending: bool) -> list[Column]:
        """Types by rank, then values; absence below everything."""
        keys = [self.v["rank"], self.v["n"], self.v["s"], self.v["b"]]
        return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]
