"""Best-fit packing of tokenised documents into sequences of a fixed length, in bulk-synchronous rounds.

A piece's place depends only on its length and on its rank among the pieces of that length. So pieces are range-sorted
by falling length (equal lengths by id, which splits a length that a third of all pieces share over many tasks), each
task numbers its own, and the counts of (task, length) pairs, at most the sequence length plus the number of tasks,
give every piece its rank. A round takes the next length: its pieces, by rank, sweep the open gaps from the smallest
that holds one upwards, each gap taking as many as it can; gaps shrink and the next round follows; what finds no gap
opens new sequences. Gaps of equal size are kept as intervals of sequence numbers, so a round handles them at once and
all rounds together a table whose size is bounded by the sequence length, whatever the number of documents. The result
is that of best-fit decreasing, one piece at a time. Tasks then look up their pieces' intervals by rank.
"""

from __future__ import annotations

import bisect
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, words

#: Pieces in a task of the range sort.
PIECES = 200_000
#: From this first byte of a character on (U+0240) the fast tokenizer's character classes may be of another Unicode version.
_PLAIN = 0xC9


def default_tokenizer() -> tuple[str, str]:
    """Paths of the vocabulary and of the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _exact(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _fast(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, vocabulary: str, ranks: str | None) -> np.ndarray:
    """Token ids of a text. The ranks give the same ids faster; texts with rarer characters or marks of special tokens take the exact way."""
    if ranks and "<|" not in text and (text.isascii() or np.frombuffer(text.encode(), np.uint8).max() < _PLAIN):
        return _fast(ranks).encode_to_numpy(text, disallowed_special=())
    return np.array(_exact(vocabulary).encode(text, add_special_tokens=False).ids, np.uint32)


def best_fit(counts: dict[int, int], length: int) -> list[tuple[int, int, int, int, int]]:
    """Intervals (size, first rank, first sequence, pieces in a sequence, offset) that place counts[size] pieces of each size."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> intervals of sequences (first, number)
    sizes: list[int] = []
    plan, fresh = [], 0

    def add(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, number))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect.bisect_left(sizes, size)
            if at == len(sizes):
                gap, first, number = length, fresh, -(-left // (length // size))
                fresh += number
            else:
                gap = sizes[at]
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            each = gap // size
            used = min(number, left // each)
            if used:
                plan.append((size, rank, first, each, length - gap))
                add(gap - each * size, first, used)
                rank, left = rank + used * each, left - used * each
            if used < number and left and left < each:
                plan.append((size, rank, first + used, left, length - gap))
                add(gap - left * size, first + used, 1)
                used, left = used + 1, 0
            add(gap, first + used, number - used)
    return plan


def pack_documents(docs: DataFrame, length: int = 2048, end: int = 0, tokenizer: tuple[str, str | None] | None = None, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every document, its token ids and then `end`, into sequences of at most `length` tokens.

    Only a longer document is cut: all its pieces but the first have the full length. Returns per piece: id, piece, start,
    length, ids_crc32, sequence_id, offset, and with `ids` the token ids themselves.

    Null and empty texts are one token, `end`. Repeated rows are packed each. Null ids are kept. An empty table gives an
    empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    vocabulary, ranks = tokenizer or default_tokenizer()
    base = shared.texts(docs, id_col, text_col)
    kind = base.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, piece int, start long, length int, ids_crc32 long" + ", ids array<int>" * ids

    def cut(batches):
        for b in (part for whole in batches for part in words.slices(whole)):
            row, piece, start, size, crc, tokens = [], [], [], [], [], []
            for i, text in enumerate(b["text"].to_pylist()):
                own = np.append(encode(text or "", vocabulary, ranks), end).astype("<u4")
                n = -(-len(own) // length)
                at = 0
                for k in range(n):
                    to = len(own) - length * (n - 1 - k)
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    size.append(to - at)
                    crc.append(zlib.crc32(own[at:to]))
                    if ids:
                        tokens.append(own[at:to].astype(np.int32))
                    at = to
            cols = [b["doc_id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                cols.append(pa.array(tokens, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    def number(batches):
        seen: dict[int, int] = {}
        for b in batches:
            size = b["length"].to_numpy()
            rank = np.empty(len(size), np.int64)
            for s in np.unique(size):
                own = np.flatnonzero(size == s)
                rank[own] = seen.get(int(s), 0) + np.arange(len(own))
                seen[int(s)] = int(rank[own[-1]]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rank)], [*b.schema.names, "rank"])

    pieces = shared.written(base.mapInArrow(cut, fields), "pieces")
    parts = max(1, -(-pieces.count() // PIECES))
    if parts == 1:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = pieces.repartitionByRange(parts, F.desc("length"), F.col("doc_id"), F.col("piece")).sortWithinPartitions(F.desc("length"), "doc_id", "piece")
    numbered = shared.written(sorted_.withColumn("part", F.spark_partition_id()).mapInArrow(number, f"{fields}, part int, rank long"), "numbered")
    counts = sorted(((r["part"], r["length"], r["n"]) for r in numbered.groupBy("part", "length").agg(F.count("*").alias("n")).collect()))
    total: dict[int, int] = {}
    before = np.zeros(len(counts), np.int64)
    for i, (_, size, n) in enumerate(counts):
        before[i] = total.get(size, 0)
        total[size] = total.get(size, 0) + n
    plan = np.array(sorted(best_fit(total, length)), np.int64).reshape(-1, 5)
    shared_plan = spark.sparkContext.broadcast((np.array([(p << 32) | s for p, s, _ in counts], np.int64), before, plan))

    def place(batches):
        keys, base_, table = shared_plan.value
        for b in batches:
            size = b["length"].to_numpy().astype(np.int64)
            rank = b["rank"].to_numpy() + base_[np.searchsorted(keys, (b["part"].to_numpy().astype(np.int64) << 32) | size)]
            # intervals are sorted by size and first rank: the last that starts at or before the piece
            at = np.empty(len(size), np.int64)
            for s in np.unique(size):
                own = size == s
                lo, hi = np.searchsorted(table[:, 0], [s, s + 1])
                at[own] = lo + np.searchsorted(table[lo:hi, 1], rank[own], "right") - 1
            inside = rank - table[at, 1]
            each = table[at, 3]
            cols = {n: b[n] for n in b.schema.names if n not in ("part", "rank")}
            cols |= {"sequence_id": pa.array(table[at, 2] + inside // each), "offset": pa.array(table[at, 4] + inside % each * size)}
            yield pa.RecordBatch.from_pydict(cols)

    out = numbered.mapInArrow(place, f"{fields}, sequence_id long, offset long")
    out = out.withColumn("length", F.col("length").cast("long"))
    return out.withColumnRenamed("doc_id", id_col)


def op3(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents packed into sequences of 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
