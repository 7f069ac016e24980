"""Quality selection by importance resampling over hashed n-grams.

Two generative models over hashed features, the raw model from all documents, the target model from the good ones of a
bounded sample of labelled rows. Features are words, words without the marks around them, and bigrams of words, and
unigrams and bigrams of word shapes (kinds of characters, length, repetition of the word before), which hold for words never seen. Probabilities are of a document holding the
feature, so that a burst in one document counts once. A feature's log ratio counts by what it exceeds DEAD_ZONE, and
only if the target's count is Z standard errors off: rare words and topics then weigh nothing. A document's log importance weight is the sum over its features'
occurrences, tempered: SHARPNESS times, and less for longer texts, whose n-grams depend on each other the more, by
1 + words / LENGTH. Documents are drawn without replacement by Gumbel top-k: the k largest sums of log weight and Gumbel noise. k is the number of documents whose
weight reaches the value that best tells apart the labelled sample.

The noise is a function of the document's id and text, so a repeated run draws the same documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packed, shared, words

U = np.uint64
#: Hashed features: the size of the models, and so of what is broadcast (16 MB).
FEATURE_BITS = 22
PRIOR = 1.0
DEAD_ZONE = 0.5
Z = 2.0
SHARPNESS = 4.0
LENGTH = 1000
#: At most so many labelled rows are used for the target model and the cut, those with the least hashes of their ids.
LABELLED_ROWS = 65_536
_SLICES = 64


#: Kinds of bytes: other, small letter or part of a longer character, capital, digit, then each mark by itself.
_KIND = np.zeros(256, np.uint8)
_KIND[128:] = _KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
for _i, _c in enumerate(b".,!?#$%&*|:;-_/@\"'()<>"):
    _KIND[_c] = 4 + _i


def features(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all words, bare words, shapes, pairs of shapes and pairs of words, each one's text, and the texts' numbers of words."""
    w = words.scan(texts, lower=True)
    n, doc = len(w.hash), w.doc
    kind = _KIND[w.data]
    first = np.ones(n, bool)
    first[1:] = doc[1:] != doc[:-1]
    again = np.zeros(n, U)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & ~first[1:]
    shape = np.minimum(np.log2(np.maximum(w.end - w.start, 1)).astype(U), U(7)) * U(2) + again
    for at in (w.start, (w.start + w.end - 1) // 2, np.maximum(w.end - 2, w.start), w.end - 1):
        shape = shape * U(32) + kind[at]
    shape = words.mix(shape + U(12345))
    pair = np.flatnonzero(~first[1:])
    two = words.mix(shape[pair] * U(0xA24BAED4963EE407) + shape[pair + 1])
    core = words.hashes(w.read, *_inner(w, kind), seed=99)
    bigram = words.mix(w.hash[pair] * U(0xD6E8FEB86659FD93) + w.hash[pair + 1] + U(7))
    hashes = np.concatenate([w.hash, core, shape, two, bigram])
    doc = doc.astype(np.int32)
    return (hashes >> U(64 - FEATURE_BITS)).astype(np.int32), np.concatenate([doc, doc, doc, doc[pair], doc[pair]]), w.counts


def _inner(w: words.Words, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's range of bytes without the marks around it; of a word of marks the last byte."""
    plain = (kind >= 1) & (kind <= 3)
    at = np.arange(len(kind))
    after = np.minimum.accumulate(np.where(plain, at, len(kind))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(plain, at, -1))
    start = np.minimum(after[w.start], w.end - 1)
    return start, np.maximum(before[w.end - 1] + 1, start + 1)


def _model(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """For each feature the numbers of all texts and of good ones that have it; the numbers of all texts and of good ones."""
    size = 1 << FEATURE_BITS

    def count(batches):
        raw, target = np.zeros(size, np.int32), np.zeros(size, np.int32)
        n = np.zeros(2, np.int64)
        for b in (part for whole in batches for part in words.slices(whole)):
            f, doc, _ = features(b["text"])
            good = b["good"].to_numpy(zero_copy_only=False) > 0
            one = np.unique(doc.astype(np.int64) << FEATURE_BITS | f)
            f, doc = one & (size - 1), one >> FEATURE_BITS
            np.add.at(raw, f, 1)
            np.add.at(target, f[good[doc]], 1)
            n += (len(good), good.sum())
        part = size // _SLICES
        yield from packed.request_rows([(i, 0, 0, packed.frame(packed.pack(raw[i * part : (i + 1) * part]), packed.pack(target[i * part : (i + 1) * part]), packed.pack(n))) for i in range(_SLICES)]).to_batches()

    def total(t: pa.Table) -> pa.Table:
        sums = [0, 0, 0]
        for p in t["payload"]:
            sums = [s + packed.unpack(x).astype(np.int64) for s, x in zip(sums, packed.unframe(p.as_py()))]
        return packed.request_rows([(t["bucket"][0].as_py(), 0, 0, packed.frame(*map(packed.pack, sums)))])

    rows = docs.select("text", "good").mapInArrow(count, packed.REQUEST).groupBy("bucket").applyInArrow(total, packed.REQUEST).collect()
    if not rows:
        return np.zeros(size, np.int64), np.zeros(size, np.int64), 0, 0
    parts = [packed.unframe(r["payload"]) for r in sorted(rows, key=lambda r: r["bucket"])]
    n = packed.unpack(parts[0][2])
    return *(np.concatenate([packed.unpack(p[k]) for p in parts]) for k in range(2)), int(n[0]), int(n[1])


def log_ratios(raw: np.ndarray, target: np.ndarray, n_raw: int, n_target: int) -> np.ndarray:
    """Each feature's log ratio of target and raw probability, as far as it is large and certain."""
    expected = raw * (n_target / max(n_raw, 1))
    ratio = np.log((target + PRIOR) / (expected + PRIOR))
    ratio[np.abs(target - expected) < Z * np.sqrt(expected + 1)] = 0.0
    return np.sign(ratio) * np.maximum(np.abs(ratio) - DEAD_ZONE, 0)


def best_cut(weight: np.ndarray, good: np.ndarray) -> float:
    """The weight that parts good from bad with the largest sum of the shares told right; the middle between neighbours."""
    order = np.argsort(weight)
    w, g = weight[order], good[order].astype(bool)
    if not len(w) or g.all() or not g.any():
        return -np.inf
    right = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum() + (g.sum() - np.concatenate([[0], np.cumsum(g)])) / g.sum()
    ok = np.concatenate([[True], w[1:] > w[:-1], [True]])  # a cut falls between different weights
    best = int(np.argmax(np.where(ok, right, -1)))
    if best == 0:
        return -np.inf
    return float((w[best - 1] + w[best]) / 2) if best < len(w) else np.inf


def kth_largest(df: DataFrame, column: str, k: int, few: int = 65_536) -> float:
    """The k-th largest value of a double column, found by narrowing histograms; never more than `few` values are gathered."""
    if k <= 0:
        return np.inf
    low, high, above, n = df.agg(F.min(column), F.max(column), F.lit(0), F.count(column)).first()
    if k >= n:
        return -np.inf
    bins = 4096
    while n > few and low < high:
        step = (high - low) / bins
        if step <= 0 or low + step == low:
            break
        at = F.least(F.floor((F.col(column) - low) / step), F.lit(bins - 1))
        got = sorted(df.where((F.col(column) >= low) & (F.col(column) <= high)).groupBy(at.alias("bin")).agg(F.count("*"), F.min(column), F.max(column)).collect(), key=lambda r: -r[0])
        for r in got:
            if above + r[1] >= k:
                low, high, n = r[2], r[3], r[1]
                break
            above += r[1]
    if low == high or n > few:
        return low
    values = [r[0] for r in df.where((F.col(column) >= low) & (F.col(column) <= high)).select(column).collect()]
    return sorted(values, reverse=True)[k - above - 1]


def weighted(docs: DataFrame, labels: DataFrame, good: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, float, float]:
    """All rows of `docs`, columns renamed c0, c1, ..., with `log_weight` and `gumbel_key`; the cut in weight; the key of the k-th drawn."""
    spark = docs.sparkSession
    good = (labels["quality"] == 1) & (labels["toxic"] == 0) if good is None else good
    sample = labels.select(labels[id_col].alias("label_id"), F.coalesce(good, F.lit(False)).cast("int").alias("good")).where("label_id IS NOT NULL")
    sample = sample.groupBy("label_id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("label_id"), "label_id").limit(LABELLED_ROWS)
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    column = f"c{names.index(text_col)}"
    if inner.schema[column].dataType.simpleString() != "string":
        inner, column = inner.withColumn("text", F.col(column).cast("string")), "text"
    text, key = F.col(column), F.col(f"c{names.index(id_col)}")
    base = inner.withColumns({"noise": -F.log(-F.log((F.pmod(F.xxhash64(F.lit(17), key, text), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))))})
    marked = base.join(F.broadcast(sample), key == sample["label_id"], "left")
    ratio = spark.sparkContext.broadcast(log_ratios(*_model(marked.select(text.alias("text"), "good"))).astype(np.float32))

    def weigh(keep: list[str]):
        def run(batches):
            for b in (part for whole in batches for part in words.slices(whole, column)):
                f, doc, n_words = features(b[column])
                sums = SHARPNESS * np.bincount(doc, weights=ratio.value[f], minlength=b.num_rows) / (1 + n_words / LENGTH)
                yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(sums)], [*keep, "log_weight"])

        return run

    table = shared.written(marked.select("good", "noise", column).mapInArrow(weigh(["good", "noise"]), "good int, noise double, log_weight double"), "weights")
    seen = table.where("good IS NOT NULL").select("log_weight", "good").toPandas()
    cut = best_cut(seen["log_weight"].to_numpy(), seen["good"].to_numpy())
    keys = table.select((F.col("log_weight") + F.col("noise")).alias("key"))
    k = table.where(F.col("log_weight") >= F.lit(float(cut))).count()
    least = kth_largest(keys, "key", k)
    kept = [f for f in base.schema if f.name != "text"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    out = base.mapInArrow(weigh([f.name for f in kept]), f"{fields}, log_weight double")
    return out.withColumn("gumbel_key", F.col("log_weight") + F.col("noise")).drop("noise"), cut, least


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", scores: bool = True) -> DataFrame:
    """The drawn rows of `docs`, all columns, and with `scores` their `log_weight` and `gumbel_key`.

    `labels` has the id, `quality` and `toxic` of some rows; a row is good if its quality is 1 and its toxicity 0 in all
    its labels, a null label counts as bad, and labels without an id or a document don't matter. Without good or without
    bad labels every document is drawn. Null and empty texts have weight 0, as a text has that can't be told. Repeated
    rows have the same key and are drawn or left together, so that k may be passed on a tie. An empty table gives an
    empty result. Other columns, whatever their names, are returned as they are.
    """
    out, _, least = weighted(docs, labels, None, id_col, text_col)
    out = out.where(F.col("gumbel_key") >= F.lit(float(least)))
    return out.toDF(*docs.columns, "log_weight", "gumbel_key") if scores else out.drop("log_weight", "gumbel_key").toDF(*docs.columns)


def op6(spark, sf_dir: str) -> DataFrame:
    """The documents drawn, with their weights and keys."""
    out = resample(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "log_weight", "gumbel_key")
