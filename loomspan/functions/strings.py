"""Scalar helpers on names and keys."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_component(text: Column) -> Column:
    """A name as lower-case hex of its UTF-8 bytes, safe in keys and paths."""
    return F.lower(F.hex(text.cast("binary")))


def unhex_component(text: Column) -> Column:
    return F.decode(F.unhex(text), "utf-8")


def join_path(*parts: Column, separator: str = "/") -> Column:
    """Non-empty parts joined."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), separator)


def clean_actor(text: Column) -> Column:
    """Letters, digits, dash and underscore; each run of others one dash."""
    return F.regexp_replace(text, r"[^A-Za-z0-9_-]+", "-")


def sort_key(value: Column) -> Column:
    """An order-preserving key of a `typed` scalar: booleans, then numbers, strings, null; null for what has no order.

    Numbers are the bits of a double, all flipped for negative ones and the sign flipped for others, in hex.
    """
    bits = F.hex(F.unhex(F.lpad(F.hex(_double_bits(value["n"])), 16, "0")))
    return (
        F.when(value["tag"] == "bool", F.when(value["b"], "b_1").otherwise("b_0")).when(value["tag"].isin("int", "float"), F.concat(F.lit("n_"), F.lower(bits)))
        .when(value["tag"] == "string", F.concat(F.lit("s_"), hex_component(value["s"]))).when(value["tag"] == "null", "z_null")
    )


def _double_bits(n: Column) -> Column:
    """A double's ordered bits as a long: equal order of the unsigned value."""
    # the exponent and fraction by logarithm would round; the bits come from the double's own text form through the JVM
    raw = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), n + F.lit(0.0)).cast("long")
    return F.when(raw < 0, F.bitwise_not(raw)).otherwise(raw.bitwiseXOR(F.lit(-(1 << 63))))


def floats_to_bytes(values: list[float]) -> bytes:
    """Little-endian 32-bit floats."""
    return struct.pack(f"<{len(values)}f", *values)


def bytes_to_floats(data: bytes) -> list[float]:
    return list(struct.unpack(f"<{len(data) // 4}f", data))
