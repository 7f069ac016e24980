"""Removal of word sequences that occur more than once in a corpus, found by recompression.

Every text is rewritten in rounds. A round first names each maximal run of one symbol, then deals the symbols into two
classes by a hash of their names and names each adjacent (first class, second class) pair. A name is a 64-bit hash of
what it stands for, so it is the same in every text and no name table has to be gathered. Each symbol carries the range
of words that its making depended on; a window that holds the whole range holds the same symbol wherever it occurs.
So a window that holds a symbol seen only once in the corpus can't be repeated. The windows that are left, those whose
symbols are all shared, are verified: two hashes of the window, from independent values of its words, must meet again, 128 bits.

Three passes over the texts, which are shuffled once and read from that shuffle; what is exchanged in between is a
few bytes for each symbol or surviving window (see packed.py).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed, words

U = np.uint64
#: Rounds of recompression: symbols then stand for three words on average and depend on about twenty.
ROUNDS = 4


def recompress(names: np.ndarray, off: np.ndarray, rounds: int = ROUNDS):
    """Symbols of each text after `rounds`: names, and the range [lo, hi) of words each depends on.

    off: the texts' ranges in `names`. A range that leaves its text (what a symbol is may depend on where the text
    ends) is marked by lo = -1.
    """
    n = len(names)
    lo, hi = np.arange(n), np.arange(1, n + 1)
    first = np.zeros(n, bool)
    first[off[:-1][np.diff(off) > 0]] = True
    edge = np.zeros(n, bool)  # depends on an end of its text
    for r in range(rounds):
        # runs: the neighbours decide where one ends
        new = first.copy()
        new[1:] |= names[1:] != names[:-1]
        at = np.flatnonzero(new)
        if not len(at):
            break
        last = np.append(at[1:], len(names)) - 1
        size = last - at + 1
        start = first[at]
        end = np.append(start[1:], True)
        lo2, hi2 = lo[np.maximum(at - 1, 0)], hi[np.minimum(last + 1, len(names) - 1)]
        edge2 = start | end | edge[at] | edge[last] | edge[np.maximum(at - 1, 0)] | edge[np.minimum(last + 1, len(names) - 1)]
        names = np.where(size > 1, words.mix(names[at] * U(0xD6E8FEB86659FD93) + size.astype(U)), names[at])
        lo, hi, first, edge = lo2, hi2, start, edge2
        # pairs: a symbol of the first class takes a following one of the second
        n = len(names)
        second = (words.mix(names + U(r + 1)) & U(1)).astype(bool)
        joins = np.zeros(n, bool)
        joins[:-1] = ~second[:-1] & second[1:] & ~first[1:]
        taken = np.zeros(n, bool)
        taken[1:] = joins[:-1]
        left = second & ~taken  # asked its left neighbour
        right = ~second & ~joins  # asked its right neighbour
        prev, nxt = np.maximum(np.arange(n) - 1, 0), np.minimum(np.arange(n) + 1, n - 1)
        ends = np.append(first[1:], True)
        lo2 = np.where(left, lo[prev], lo)
        hi2 = np.where(right | joins, hi[nxt], hi)
        edge2 = edge | (left & (first | edge[prev])) | (right & (ends | edge[nxt])) | (joins & edge[nxt])
        names2 = np.where(joins, words.mix(names * U(0xA24BAED4963EE407) + names[nxt] + U(r)), names)
        keep = ~taken
        names, lo, hi, first, edge = names2[keep], lo2[keep], hi2[keep], first[keep], edge2[keep]
    return names, np.where(edge, -1, lo), hi


def _symbols(w: words.Words, width: int):
    """Distinct names of the symbols that a window can hold whole, and each one's range."""
    names, lo, hi = recompress(w.hash, w.off)
    held = (lo >= 0) & (hi - lo <= width)
    names, lo, hi = names[held], lo[held], hi[held]
    keys, extra, total, place = packed.distinct(names, np.zeros(len(names), np.uint32))
    return keys, extra, total, place, lo, hi


def _left(w: words.Words, width: int, shared: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Windows none of whose symbols is unique: start positions and two hashes."""
    at, first = words.windows(w, width)
    lone = ~shared
    mark = np.zeros(len(w.hash) + width + 2, np.int64)
    begin = np.maximum(hi[lone] - width, w.off[np.searchsorted(w.off, lo[lone], "right") - 1])
    np.add.at(mark, begin, 1)
    np.add.at(mark, lo[lone] + 1, -1)
    open_ = np.cumsum(mark)[at] == 0
    at = at[open_]
    second = words.mix(words.spans(w.again(1), at, at + width))
    return at, first[open_], second


def repeated(w: words.Words, width: int, ask=None, shared=None, again=None, chunk: int = 0, buckets: int = 8):
    """One chunk's part of each of the three passes; the last returns which words to remove."""
    keys, extra, total, place, lo, hi = _symbols(w, width)
    if ask == "symbols":
        return packed.repeats_asked(keys, extra, total, chunk, buckets, 0)
    at, first, second = _left(w, width, shared[place], lo, hi)
    keys, extra, total, place = packed.distinct(first, second)
    if ask == "windows":
        return packed.repeats_asked(keys, extra, total, chunk, buckets, 1)
    cover = np.zeros(len(w.hash) + 1, np.int64)
    hit = at[again[place]]
    cover[hit] += 1  # starts are distinct
    cover[hit + width] -= 1
    return np.cumsum(cover)[:-1] > 0


def remove_repeats(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes each word covered by a `width`-word window whose words also start anywhere else in the corpus.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Windows are judged on the input, so all copies of a repeat go, the first
    too. Returns id, the `carry` columns, n_words, n_removed and `kept`: the text itself where nothing was removed, else
    the kept words joined by one space.

    Null and empty texts have no words; texts shorter than a window lose none. Repeated rows are each other's copies, so
    they lose all words from a window on. Null ids are kept as they are. An empty table gives an empty result. Columns
    not named in `carry` are ignored and may have any name.
    """
    spark = docs.sparkSession
    chunks, buckets = packed.chunks_for(docs.count())
    spare = [f"c{i}" for i in range(len(carry))]
    base = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), *[docs[c].alias(s) for c, s in zip(carry, spare)])
    base = packed.with_chunk(base, chunks, F.col("id"), F.col("text"))

    def ask_symbols(t: pa.Table) -> pa.Table:
        return packed.request_rows(repeated(words.scan(t["text"]), width, "symbols", chunk=t["chunk"][0].as_py(), buckets=buckets))

    def ask_windows(t: pa.Table, found: pa.Table) -> pa.Table:
        if not t.num_rows:
            return packed.request_rows([])
        return packed.request_rows(repeated(words.scan(t["text"]), width, "windows", packed.repeats_read(found, 0), chunk=t["chunk"][0].as_py(), buckets=buckets))

    kept = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def remove(t: pa.Table, found: pa.Table) -> pa.Table:
        out = t.select(["id", *spare])
        if not t.num_rows:
            return pa.table({**{c: out[c] for c in out.column_names}, **{f.name: pa.array([], f.type) for f in kept}})
        w = words.scan(t["text"])
        gone = repeated(w, width, None, packed.repeats_read(found, 0), packed.repeats_read(found, 1))
        lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.off])
        texts = t["text"].combine_chunks()
        stay = ~gone
        new = [texts[i].as_py() or "" if not lost[i] else w.text(stay, i) for i in range(t.num_rows)]
        cols = {c: out[c] for c in out.column_names}
        return pa.table(cols | {"n_words": pa.array(w.counts, pa.int64()), "n_removed": pa.array(lost, pa.int64()), "kept": pa.array(new, pa.string())})

    by_chunk = base.groupBy("chunk")
    found = by_chunk.applyInArrow(ask_symbols, packed.REQUEST).groupBy("bucket").applyInArrow(packed.repeats_answered, packed.REQUEST)
    again = by_chunk.cogroup(found.groupBy("chunk")).applyInArrow(ask_windows, packed.REQUEST).groupBy("bucket").applyInArrow(packed.repeats_answered, packed.REQUEST)
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in base.schema if f.name not in ("text", "chunk")]
    out = by_chunk.cogroup(found.unionByName(again).groupBy("chunk")).applyInArrow(remove, ", ".join([*fields, "n_words long", "n_removed long", "kept string"]))
    names = {"id": id_col, **dict(zip(spare, carry))}
    return out.select(*[F.col(a).alias(b) for a, b in names.items()], "n_words", "n_removed", "kept")


def op8(spark, sf_dir: str) -> DataFrame:
    """Contract query: words removed from each document and the digest of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeats(docs)
    words_only = F.array_join(F.filter(F.split("kept", "[ \\t-\\r]+"), lambda x: x != ""), " ")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(words_only), 256).alias("kept_sha256"))


OP8_SQL = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS win FROM s),
r AS (SELECT win FROM k GROUP BY win HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM k JOIN r ON k.win = r.win),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
o AS (SELECT p.doc_id, count(*) FILTER (WHERE g.pos IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY p.pos) FILTER (WHERE g.pos IS NULL) AS kept
      FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o ON d.doc_id = o.doc_id
"""
