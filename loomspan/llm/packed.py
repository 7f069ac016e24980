"""A request/response exchange between chunks of texts and buckets of keys, in compressed binary blobs.

Chunks ask about sorted distinct 64-bit keys; each bucket sees all chunks' questions about its keys and answers in the
order asked, so answers need no keys. A key that is in every text costs a chunk one entry, so hot keys don't pile up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_codec = pa.Codec("zstd", compression_level=1)

#: Texts in a chunk: the unit that is read and answered at once.
CHUNK_TEXTS = 512


def pack(a: np.ndarray) -> bytes:
    """An array as bytes: byte planes, compressed."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else np.empty(0, np.uint8)
    raw = np.ascontiguousarray(planes).tobytes()
    return a.dtype.str.encode().ljust(8) + len(a).to_bytes(8, "little") + (_codec.compress(raw, asbytes=True) if raw else b"")


def unpack(b: bytes) -> np.ndarray:
    kind, n = np.dtype(b[:8].decode().strip()), int.from_bytes(b[8:16], "little")
    if not n:
        return np.empty(0, kind)
    raw = np.frombuffer(_codec.decompress(b[16:], n * kind.itemsize, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).reshape(-1).view(kind)


def pack_sorted(a: np.ndarray) -> bytes:
    """Non-decreasing uint64 values as differences."""
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def pack_columns(*columns: np.ndarray) -> bytes:
    """Arrays of one length as one stream of byte planes, with a short header: for many small requests."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in columns] if len(columns[0]) else []
    head = len(columns[0]).to_bytes(4, "little") + bytes([len(columns)]) + b"".join(a.dtype.str[1:].encode() for a in columns)
    return head + (_codec.compress(b"".join(planes), asbytes=True) if planes else b"")


def unpack_columns(b: bytes) -> list[np.ndarray]:
    n, k = int.from_bytes(b[:4], "little"), b[4]
    kinds = [np.dtype(b[5 + 2 * i : 7 + 2 * i].decode()) for i in range(k)]
    if not n:
        return [np.empty(0, kind) for kind in kinds]
    raw = np.frombuffer(_codec.decompress(b[5 + 2 * k :], n * sum(kind.itemsize for kind in kinds), asbytes=True), np.uint8)
    out, at = [], 0
    for kind in kinds:
        out.append(np.ascontiguousarray(raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return out


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of `buckets` equal ranges of the 64-bit space starts in sorted keys; with the end appended."""
    cuts = [(i << 64) // buckets for i in range(1, buckets)]
    inner = np.searchsorted(keys, np.array(cuts, np.uint64)) if cuts else np.empty(0, np.int64)
    return np.concatenate([[0], inner, [len(keys)]]).astype(np.int64)


def chunks_for(rows: int) -> tuple[int, int]:
    """Numbers of chunks and of buckets for a table of so many texts; both grow with it."""
    chunks = max(8, -(-rows // CHUNK_TEXTS))
    return chunks, max(8, chunks // 4)


def with_chunk(df: DataFrame, chunks: int, *by: Column) -> DataFrame:
    """Adds `chunk`, evenly dealt by a hash of the given columns."""
    return df.withColumn("chunk", F.pmod(F.xxhash64(*by), F.lit(chunks)).cast("int"))


REQUEST = "bucket int, chunk int, kind int, payload binary"


def request_rows(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [(), (), (), ()]
    return pa.table({"bucket": pa.array(cols[0], pa.int32()), "chunk": pa.array(cols[1], pa.int32()), "kind": pa.array(cols[2], pa.int32()), "payload": pa.array(cols[3], pa.binary())})


def frame(*parts: bytes) -> bytes:
    """Several blobs in one."""
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unframe(b: bytes) -> list[bytes]:
    out, i = [], 0
    while i < len(b):
        n = int.from_bytes(b[i : i + 8], "little")
        out.append(b[i + 8 : i + 8 + n])
        i += 8 + n
    return out


def distinct(keys: np.ndarray, extra: np.ndarray | None = None, weight: np.ndarray | None = None):
    """Sorted distinct (key, extra), the total weight of each, and each input's place among them."""
    order = np.argsort(keys, kind="stable") if extra is None else np.lexsort((extra, keys))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    x = None
    if extra is not None:
        x = extra[order]
        new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    w = np.ones(len(k), np.int64) if weight is None else weight[order].astype(np.int64)
    total = np.add.reduceat(w, at) if len(at) else np.empty(0, np.int64)
    return k[at], (None if x is None else x[at]), total, place


def repeats_asked(keys: np.ndarray, extra: np.ndarray, total: np.ndarray, chunk: int, buckets: int, kind: int) -> list[tuple[int, int, int, bytes]]:
    """Requests: does (key, extra) occur twice or more, over all chunks?"""
    edges = bucket_edges(keys, buckets)
    many = (total > 1).astype(np.uint8)
    return [(b, chunk, kind, frame(pack_sorted(keys[i:j]), pack(extra[i:j]), pack(np.packbits(many[i:j])))) for b, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if j > i]


def repeats_answered(table: pa.Table) -> pa.Table:
    """One bucket: for each chunk's request, a bit per key that tells whether it occurs twice or more anywhere."""
    rows = table.select(["bucket", "chunk", "kind", "payload"]).to_pylist()
    keys, extra, weight, sizes = [], [], [], []
    for r in rows:
        k, x, m = unframe(r["payload"])
        keys.append(unpack_sorted(k))
        extra.append(unpack(x))
        sizes.append(len(keys[-1]))
        weight.append(np.unpackbits(unpack(m), count=sizes[-1]) + 1)
        r["payload"] = None
    _, _, total, place = distinct(np.concatenate(keys), np.concatenate(extra), np.concatenate(weight))
    many = (total > 1)[place]
    out, at = [], 0
    for r, n in zip(rows, sizes):
        out.append((r["bucket"], r["chunk"], r["kind"], frame(pack(np.packbits(many[at : at + n])), n.to_bytes(8, "little"))))
        at += n
    return request_rows(out)


def repeats_read(table: pa.Table, kind: int) -> np.ndarray:
    """A chunk's answers of one kind, in the order it asked."""
    rows = sorted(((r["bucket"], r["payload"]) for r in table.to_pylist() if r["kind"] == kind), key=lambda r: r[0])
    bits = [np.unpackbits(unpack(a), count=int.from_bytes(n, "little")) for a, n in (unframe(p) for _, p in rows)]
    return np.concatenate(bits).astype(bool) if bits else np.empty(0, bool)
