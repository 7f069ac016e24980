"""Vectorised word scanning over Arrow string buffers: no Python object per word.

A word's 64-bit value chains its blocks of eight bytes through avalanche steps, one block of all words at a time; what
is longer than LONG bytes is hashed by xxh3. Each step is one-to-one, so words of equal length up to eight bytes never
share a value; others do by chance alone, one pair in 2**64. A second value with another seed is independent of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
BASE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes from which a span is hashed by itself.
LONG = 128
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
_pow = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_pow[0]) < n:
        n2 = max(n, _SEGMENT + 1)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            a = np.full(n2, U(base))
            a[0] = 1
            _pow[k] = np.cumprod(a, dtype=U)
    return _pow[0], _pow[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def spans(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[start:end] for non-decreasing starts, in slices of bounded memory."""
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(start, base + _SEGMENT)))
        size = int(end[i:j].max()) - base
        up, down = powers(size + 1)
        total = np.zeros(size + 1, U)
        np.cumsum(values[base : base + size] * up[:size], out=total[1:], dtype=U)
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return out


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit value of each span data[start:end] of bytes."""
    size = end - start
    out = mix(size.astype(U) * U(BASE) + U(seed))
    block = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at = start[live]
    left = size[live]
    while len(live):
        out[live] = mix((out[live] ^ (block[at] & _KEEP[np.minimum(left, 8)])) + U(BASE))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), seed=seed)
    return out


class Words:
    """The words of a batch of texts: hash, start and end byte of each, each text's range of words, and the bytes as they were hashed."""

    __slots__ = ("data", "end", "hash", "off", "read", "start")

    def __init__(self, data, start, end, hash_, off, read):
        self.data, self.start, self.end, self.hash, self.off, self.read = data, start, end, hash_, off, read

    def again(self, seed: int) -> np.ndarray:
        """Values of the words that are independent of `hash`."""
        return hashes(self.read, self.start, self.end, seed)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), self.counts)

    def text(self, keep: np.ndarray, i: int) -> str:
        """The kept words of text i, joined by one space."""
        a, b = self.off[i], self.off[i + 1]
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[a:b][keep[a:b]], self.end[a:b][keep[a:b]])).decode()


def buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def scan(texts, lower: bool = False) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of each text; with `lower`, A-Z are a-z."""
    data, off = buffers(texts)
    n = len(data)
    if not n:
        empty = np.empty(0, np.int64)
        return Words(data, empty, empty, np.empty(0, U), np.zeros(len(off), np.int64), data)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    del first, last, inside
    read = _LOWER[data] if lower else data
    return Words(data, start, end, hashes(read, start, end), np.searchsorted(start, off), read)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions (in words) of all k-word windows that lie in one text, and their hashes."""
    n = len(w.hash)
    if n < k:
        return np.empty(0, np.int64), np.empty(0, U)
    ok = np.ones(n, bool)
    for i in range(1, k):  # the last k-1 words of a text start no window
        ends = w.off[1:] - i
        ok[ends[(ends >= w.off[:-1]) & (ends >= 0)]] = False
    at = np.flatnonzero(ok)
    return at, mix(spans(w.hash, at, at + k))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20):
    """Consecutive parts of a batch with about `most` bytes of text each, one row at least."""
    texts = batch.column(batch.schema.get_field_index(column))
    if not batch.num_rows:
        return
    _, off = buffers(texts)
    i = 0
    while i < batch.num_rows:
        j = min(max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1), batch.num_rows)
        yield batch.slice(i, j - i)
        i = j
