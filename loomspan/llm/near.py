"""N-gram Jaccard join by a MinHash LSH forest, with exact verification, and the groups its links form.

Texts with equal shingle sets form a class; only one row of a class goes on. Its MinHash signature is split into TREES
tries, of which only the nodes at one depth are used: each row is dealt out by a hash of its prefix of d minima, which is
banding. d depends on the threshold alone; it is the longest for which the probability that two sets at the threshold share
a node in any trie, 1-(1-s**d)**TREES, reaches the target recall. Tries aren't sorted, nor prefixes shortened by what was
matched: a join by a threshold needs all pairs that agree on d minima, and pairs that agree on more are among them.

Rows under one node are linked to the node's least row, not to each other, and the components of these links are the
candidate groups. Within a candidate group all pairs are verified exactly, on whole shingle sets. A large group is cut
into blocks and each pair of blocks is verified in its own task; a task returns each row's number of links and a
spanning forest, never the pairs. So links cost rows in proportion to the texts, and a hot group spreads over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed, shared, words

U = np.uint64
TREES = 20
MAX_DEPTH = 8
RECALL = 0.9999
#: Rows of a block in the verification of large groups.
BLOCK = 128
BLOCK_SHINGLES = 200_000
#: Copies of what is known of a group, so that a large group's members are joined with it in that many tasks.
SALT = 16
_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, TREES * MAX_DEPTH, dtype=np.uint64) * U(2) + U(1)


def depth_for(similarity: float, trees: int = TREES, recall: float = RECALL) -> int:
    """The longest prefix with which a pair at the threshold meets in some trie with the target probability."""
    depth = MAX_DEPTH
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and the texts' ranges. A text of fewer words, but not none, is one shingle."""
    w = words.scan(texts, lower=True)
    at, h = words.windows(w, size)
    doc = np.searchsorted(w.off, at, "right") - 1
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        h = np.concatenate([h, words.mix(words.spans(w.hash, w.off[short], w.off[short + 1]) + U(1))])
        doc = np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(w.off)))


def signatures(h: np.ndarray, off: np.ndarray, depth: int, trees: int = TREES) -> np.ndarray:
    """For each non-empty set a row of `trees` prefixes, each a hash of `depth` minima and the trie's number."""
    out = np.zeros((len(off) - 1, trees), U)
    full = np.flatnonzero(np.diff(off) > 0)
    if len(full):
        for t in range(trees):
            acc = np.full(len(full), U(t + 1))
            for k in range(t * depth, (t + 1) * depth):
                x = h * _SEEDS[k]
                x ^= x >> U(32)
                acc = words.mix(acc * U(0x9E3779B97F4A7C15) + np.minimum.reduceat(x, off[full]))
            out[full, t] = acc
    return out


def classes(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit value of each whole set."""
    sums = np.concatenate([[U(0)], np.cumsum(words.mix(h + U(0x1F83D9ABFB41BD6B)), dtype=U)])
    return words.mix(sums[off[1:]] - sums[off[:-1]] + np.diff(off).astype(U))


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of undirected edges (u, v): rows (u, l), l the least vertex of u's component.

    First each u keeps the edge to its least neighbour m, and its other neighbours get one to m in its place: where many
    vertices share a few hubs, these become the same few edges.
    Rounds of least-neighbour labels with a jump to the label's label; each is written, so that lost executors cost one
    round at most. Their number grows with the logarithm of a component's diameter, as a rule.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    edges = least.withColumnRenamed("m", "v").unionByName(moved).distinct()
    e = shared.written(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{name}-edges")
    labels = shared.written(e.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")), f"{name}-labels")
    while True:
        near = e.join(labels.select(F.col("u").alias("v"), F.col("l").alias("m")), "v").groupBy("u").agg(F.min("m").alias("m"))
        less = labels.join(near, "u").select("u", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        jump = labels.select(F.col("u").alias("l"), F.col("l").alias("m"))
        labels_next = shared.written(less.join(jump, "l", "left").select("u", "old", F.least("l", F.coalesce("m", "l")).alias("l")), f"{name}-labels")
        changed = labels_next.where("l < old").limit(1).count()
        labels = labels_next.select("u", "l")
        if not changed:
            return labels


def _links(rows: pa.Table, similarity: float) -> pa.Table:
    """One pair of blocks (or one block with itself): each row's links and its root in the links found here."""
    rows = rows.take(pa.array(np.unique(rows["v"].to_numpy(), return_index=True)[1]))  # repeated rows bring a class twice
    ids = rows["v"].to_numpy()
    block = rows["block"].to_numpy()
    weight = rows["copies"].to_numpy()
    sets = [packed.unpack_sorted(b) for b in rows["set"].to_pylist()]
    a, b = rows["a"][0].as_py(), rows["b"][0].as_py()
    n = len(ids)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if n else np.empty(0, U)
    owner = np.repeat(np.arange(n), size)
    _, place, seen = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.zeros((n, n), np.float32)
    shared_ = np.flatnonzero(seen > 1)
    column = np.full(len(seen), -1)
    column[shared_] = np.arange(len(shared_))
    column = column[place]
    for at in range(0, len(shared_), 16384):  # bounded slices of the shingles that two rows or more have
        own = (column >= at) & (column < at + 16384)
        x = np.zeros((n, min(16384, len(shared_) - at)), np.float32)
        x[owner[own], column[own] - at] = 1
        common += x @ x.T
    union = size[:, None] + size[None, :] - common
    linked = common >= similarity * union - 1e-6
    np.fill_diagonal(linked, False)
    if a != b:  # pairs within a block are found where the block meets itself
        linked &= (block[:, None] == a) != (block[None, :] == a)
    links = linked @ weight.astype(np.int64)
    root = np.arange(n)
    while True:
        least = np.where(linked, root[None, :], n).min(axis=1, initial=n)
        new = np.minimum(root, least)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    return pa.table({"v": pa.array(ids), "root": pa.array(ids[root]), "links": pa.array(links, pa.int64())})


def _joined_by_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (v, l, ...) with the columns of `groups` (l, ...)."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    return rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALT)).cast("int")).join(groups.withColumn("salt", salt), ["l", "salt"]).drop("salt")


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links every two texts whose sets of `size`-word shingles have a Jaccard similarity of `similarity` or more.

    Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; a text of fewer words is one shingle. Returns one row per document:
    id, `class_id` (the least id of its group, the connected component of the links), `n_links` (number of other
    documents it is linked to, copies counted each), `row_key`, a 128-bit hash of id and text, and `class_key`, the row_key of the
    group's first document, the one with the least id.

    A text without words (null, empty, blank) is linked to nothing and its class is its own id. Repeated rows are linked
    to each other. Null ids are kept and make a class only among themselves. An empty table gives an empty result.
    """
    depth = depth_for(similarity)
    base = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).withColumn("row_key", shared.row_key("id", "text"))
    kind = base.schema["id"].dataType.simpleString()

    def sign(batches):
        for b in (part for whole in batches for part in words.slices(whole)):
            h, off = shingles(b["text"], size)
            sig = signatures(h, off, depth)
            n = np.diff(off)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * TREES, pa.int32()), pa.array(sig.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b["id"], b["row_key"], pa.array(n, pa.int32()), pa.array(classes(h, off).view(np.int64)), lists], ["id", "row_key", "n", "v", "sig"])

    signed = shared.written(base.mapInArrow(sign, f"id {kind}, row_key binary, n int, v long, sig array<long>"), "signed")
    full = signed.where("n > 0")
    reps = shared.written(full.groupBy("v").agg(F.count("*").alias("copies"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key")).alias("least"), F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    nodes = reps.select("v", F.explode("sig").alias("p"))
    tops = nodes.groupBy("p").agg(F.min("v").alias("top"), F.count("*").alias("m")).where("m > 1").drop("m")
    candidates = components(nodes.join(tops, "p").where("v <> top").select(F.col("v").alias("u"), F.col("top").alias("v")), "candidates")
    candidates = candidates.withColumnRenamed("u", "v").join(reps.select("v", "copies", "row_key", "n"), "v")
    sizes = candidates.groupBy("l").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = _joined_by_group(candidates, sizes).withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))

    def sets(batches):
        for b in (part for whole in batches for part in words.slices(whole)):
            h, off = shingles(b["text"], size)
            blobs = [packed.pack_sorted(h[i:j]) for i, j in zip(off[:-1], off[1:])]
            keep = [b.schema.get_field_index(c) for c in ("l", "v", "block", "blocks", "copies")]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(blobs, pa.binary())], ["l", "v", "block", "blocks", "copies", "set"])

    texts = base.select("row_key", "text").join(members, "row_key").select("l", "v", "block", "blocks", "copies", "text")
    cells = texts.mapInArrow(sets, "l long, v long, block int, blocks int, copies long, set binary").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("l", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "v", "block", "copies", "set")
    found = shared.written(cells.groupBy("l", "a", "b").applyInArrow(lambda t: _links(t, similarity), "v long, root long, links long"), "links")
    groups = components(found.where("v <> root").select(F.col("v").alias("u"), F.col("root").alias("v")), "groups")
    links = found.groupBy("v").agg(F.sum("links").alias("links"))
    known = reps.select("v", "copies", "least").join(links, "v", "left").join(groups.withColumnRenamed("u", "v"), "v", "left").withColumn("l", F.coalesce("l", "v"))
    known = known.select("v", "l", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    firsts = known.groupBy("l").agg(F.min("least").alias("first"))
    known = _joined_by_group(known, firsts).select("v", F.col("first.id").alias("class_id"), F.col("first.row_key").alias("class_key"), "links")
    out = full.select("id", "row_key", "v").join(known, "v").select("id", "class_id", F.col("links").alias("n_links"), "row_key", "class_key")
    alone = signed.where("n = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "row_key", F.col("row_key").alias("class_key"))
    return out.unionByName(alone).withColumnRenamed("id", id_col)


def op7(spark, sf_dir: str) -> DataFrame:
    """Every document with the id of its group of near copies and its number of links."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links")


OP7_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS class_id, (SELECT count(*) FROM e WHERE e.a = d.doc_id) AS n_links FROM d
"""
