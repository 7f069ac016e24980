"""Language-model scoring with a probabilistic suffix tree over words.

States of the tree are contexts: every suffix of one to DEPTH preceding words of the same text, however frequent the
words. Contexts are tried from short to long. One is retained if its own next-symbol counts, each discounted by DISCOUNT,
code its training tokens in fewer nats than its longest retained proper suffix does by THRESHOLD at least (a leave-some-out
form of the Kullback-Leibler test: what a context saw only once can't speak for it, so one that occurs once is never
retained). A symbol is scored in the state of the longest retained suffix, whose absolute-discounted distribution is
smoothed by that of the next shorter retained one, with the discounted mass and ROOT_TOKENS pseudo-tokens; the root adds one
to each count, as the unigram base does, so all are proper distributions over the vocabulary and one unknown symbol.

Texts are read once. Slices of bounded size become chunks: their distinct words and each token's place among these. Ranges of
word hashes count and number the words. Then every position's context and symbol, as word numbers, go to the bucket of the
nearest word before it, which holds the whole subtree under that word: it counts, tests and scores all depths, and answers
with the probabilities that differ from the root's. Equal positions of a chunk are asked for once. The buckets are asked in
waves, each after the shuffles of the one before are let go.

A hot word, one with more than a bucket's tokens or one in 2**SHARE_BITS of all, would overload its bucket. Its pairs with a
symbol are dealt by word and symbol and counted there; only the word's sums are broadcast, at most 2**HOT_BITS rows. Its
positions then go, with their probability so far, to the bucket of the nearest two words; where these are hot together, the
same is done with two and with three words. So no bucket gets a group larger than that bound, and the bound changes where
contexts are counted, not the model. Each such round opens all chunks once more.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packed, shared, words

U = np.uint64
DEPTH = 3
DISCOUNT = 0.75
#: Weight of the next shorter state in every state, as a number of tokens.
ROOT_TOKENS = 2.0
#: Nats that a context's own counts must save over those of its longest retained proper suffix.
THRESHOLD = 3.0
HOT_BITS = 20
SHARE_BITS = 7
LEAST_HOT = 1 << 16
#: Bytes of text in a chunk (a longer text is one of its own), and in a range of the vocabulary; positions in a bucket.
CHUNK_BYTES = 4 << 20
RANGE_BYTES = 64 << 20
BUCKET_TOKENS = 1 << 20
#: Parts in which the buckets are asked, so that only one part's requests are on disk.
WAVES = 2
END = U(0x6A09E667F3BCC909)
MAIN = DEPTH + 1

ASKED = "bucket int, chunk long, round int, payload binary"


def hot_limit(n: int) -> int:
    """Contexts with more of n training tokens are hot."""
    return max(LEAST_HOT, min(n >> SHARE_BITS, BUCKET_TOKENS), n >> HOT_BITS)


def tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of each text, its end included, and the texts' ranges."""
    w = words.scan(texts, lower=True)
    n = len(w.off) - 1
    off = w.off + np.arange(n + 1)
    tok = np.full(off[-1], END)
    body = np.ones(len(tok), bool)
    body[off[1:] - 1] = False
    tok[body] = w.hash
    return tok, off


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """A 64-bit value of each row of word numbers."""
    acc = np.full(len(parts[0]), U(len(parts)))
    for x in parts:
        acc = words.mix((acc ^ x.astype(U)) + U(words.BASE))
    return acc


def rows_of(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [(), (), (), ()]
    return pa.table({"bucket": pa.array(cols[0], pa.int32()), "chunk": pa.array(cols[1], pa.int64()), "round": pa.array(cols[2], pa.int32()), "payload": pa.array(cols[3], pa.binary())})


def small(a: np.ndarray) -> np.ndarray:
    """Whole numbers in 32 bits where they fit."""
    return a.astype(np.uint32) if not len(a) or int(a.max()) < 1 << 32 else a.astype(U)


# chunks and vocabulary


def chunked(base: DataFrame, ranges: int) -> tuple[DataFrame, DataFrame, str]:
    """Chunks (chunk, ids, payload) and what they ask of each range of the vocabulary, distinct hashes and training counts (bucket, chunk, payload): two tables from one pass; the second's folder."""
    spark, kind = base.sparkSession, base.schema["id"].dataType.simpleString()

    def cut(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in (x for whole in batches for x in words.slices(whole, most=CHUNK_BYTES)):
            tok, off = tokens(b["text"])
            train = b["train"].to_numpy(zero_copy_only=False).astype(bool)
            keys, _, seen, place = packed.distinct(tok, None, np.repeat(train, np.diff(off)))
            chunk, n = part << 32 | n, n + 1
            edges = packed.bucket_edges(keys, ranges)
            asked = [(i, packed.frame(packed.pack_sorted(keys[a:z]), packed.pack(seen[a:z].astype(np.uint32)))) for i, (a, z) in enumerate(zip(edges[:-1], edges[1:])) if z > a]
            own = packed.frame(packed.pack(place.astype(np.uint16 if len(keys) < 1 << 16 else np.uint32)), packed.pack(np.diff(off).astype(np.uint32)), packed.pack(np.packbits(train)))
            lists = pa.ListArray.from_arrays(pa.array([0, *[b.num_rows] * (len(asked) + 1)], pa.int32()), b["id"])
            yield pa.RecordBatch.from_arrays([pa.array([True] + [False] * len(asked)), pa.array([-1, *(i for i, _ in asked)], pa.int32()), pa.array([chunk] * (len(asked) + 1), pa.int64()), lists, pa.array([own, *(p for _, p in asked)], pa.binary())], ["whole", "bucket", "chunk", "ids", "payload"])

    path = f"{shared.shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    rows = base.mapInArrow(cut, f"whole boolean, bucket int, chunk long, ids array<{kind}>, payload binary")
    rows.write.partitionBy("whole").parquet(path)
    table = spark.read.schema(f"bucket int, chunk long, ids array<{kind}>, payload binary, whole boolean").parquet(path)
    return table.where("whole").select("chunk", "ids", "payload"), table.where("NOT whole").select("bucket", "chunk", "payload"), f"{path}/whole=false"


def numbered(asked: DataFrame, ranges: int) -> DataFrame:
    """Each chunk's words as numbers from 1 on, small for frequent ones, with their training counts; and for each range its sums (chunk -1)."""

    def number(t: pa.Table) -> pa.Table:
        bucket = t["bucket"][0].as_py()
        parts = [packed.unframe(p) for p in t["payload"].to_pylist()]
        keys = [packed.unpack_sorted(a) for a, _ in parts]
        _, _, total, place = packed.distinct(np.concatenate(keys), None, np.concatenate([packed.unpack(b) for _, b in parts]))
        number = np.empty(len(total), U)
        number[np.argsort(-total, kind="stable")] = np.arange(len(total), dtype=U) * U(ranges) + U(bucket + 1)
        out, at = [], 0
        for chunk, k in zip(t["chunk"].to_pylist(), keys):
            own = place[at : at + len(k)]
            out.append((bucket, chunk, 0, packed.frame(packed.pack(small(number[own])), packed.pack(small(total[own])))))
            at += len(k)
        rows = rows_of([*out, (bucket, -1, 0, b"")])
        sums = [int(total.sum()), int((total > 0).sum()), int(total.max())]
        for name, x in zip(("tokens", "types", "most"), sums):
            rows = rows.append_column(name, pa.array([None] * len(out) + [x], pa.int64()))
        return rows

    return shared.written(asked.groupBy("bucket").applyInArrow(number, f"{ASKED}, tokens long, types long, most long"), "vocabulary")


# the tree


def retained(n, kinds, gain) -> np.ndarray:
    """Whether contexts with so many tokens and successors, and nats saved before dividing by the tokens, are states."""
    return gain - (n - kinds) * np.log(n + ROOT_TOKENS) + kinds * np.log((kinds * DISCOUNT + ROOT_TOKENS) / (n + ROOT_TOKENS)) >= THRESHOLD


def saved(own, p) -> np.ndarray:
    """Nats that a context's counts of its symbols save over probabilities p, but for the context's own count, which each token after the first is divided by."""
    return np.where(own > 0, (own - 1) * np.log(np.maximum(own - DISCOUNT, 0.25) / p), 0.0)


def smoothed(own, n, kinds, p) -> np.ndarray:
    """Probabilities in a state of symbols that the next shorter state gives p."""
    return (np.maximum(own - DISCOUNT, 0) + (DISCOUNT * kinds + ROOT_TOKENS) * p) / (n + ROOT_TOKENS)


def grown(done: np.ndarray, before: list[np.ndarray], sym: np.ndarray, seen: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of positions in their longest retained contexts, and which of them any context changed.

    done: context words already dealt with; before: numbers of the nearest, second and third word before (0: none);
    seen: training occurrences; p: probabilities so far. The positions hold all that share a context of done + 1 words.
    """
    p, changed, open_ = p.copy(), np.zeros(len(p), bool), np.ones(len(p), bool)
    for depth in range(1, DEPTH + 1):
        open_ &= (before[depth - 1] > 0) | (done >= depth)
        at = np.flatnonzero(open_ & (done < depth))
        ctx = chain([b[at] for b in before[:depth]])
        _, group = np.unique(ctx, return_inverse=True)
        n = np.bincount(group, seen[at])
        twice = n[group] > 1  # a context that occurs once is no state, nor is any longer one
        open_[at[~twice]] = False
        at, group = at[twice], group[twice]
        if not len(at):
            continue
        _, first, pair = np.unique(chain([ctx[twice], sym[at]]), return_index=True, return_inverse=True)
        own, of = np.bincount(pair, seen[at]), group[first]
        kinds = np.bincount(of, own > 0, len(n))
        kept = retained(np.maximum(n, 1), kinds, np.bincount(of, saved(own, p[at[first]]), len(n)))[of]
        new = smoothed(own, n[of], kinds[of], p[at[first]])
        hit = kept[pair]
        p[at[hit]] = new[pair[hit]]
        changed[at[hit]] = True
    return p, changed


class Chunk:
    """A chunk's tokens and what the rounds answered so far say of them.

    answers: payloads by round, in the order of buckets; states: for each round of hot contexts their sorted hashes, tokens
    and successors.
    """

    def __init__(self, payload: bytes, answers: dict[int, list[bytes]], total: int, limit: int, buckets: int, states: list):
        place, size, train = map(packed.unpack, packed.unframe(payload))
        self.off = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        self.train = np.unpackbits(train, count=len(size)).astype(bool)
        parts = [tuple(map(packed.unpack, packed.unframe(p))) for p in answers.get(0, [])]
        number, count = (np.concatenate([x[k].astype(U) for x in parts]) for k in range(2))
        order = np.argsort(number)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.numbers, self.local = number[order], rank[place]  # tokens as places among the chunk's sorted numbers
        self.count = count[place].astype(np.float64)
        self.p = (self.count + 1) / total
        self.place = np.arange(len(place)) - np.repeat(self.off[:-1], size)
        self.limit, self.buckets = limit, buckets
        self.done = np.zeros(len(place), np.uint8)
        self.live, self.hot = self.after(self.count > 1), self.after(self.count > limit)
        for depth, (ctx, n, kinds) in enumerate(states, 1):
            at, pairs, into, context, _ = self.hot_pairs(depth)
            own = np.concatenate([np.zeros(0), *(packed.unpack(p) for p in answers.get(depth, []))])
            near = np.minimum(np.searchsorted(ctx, context), max(len(ctx) - 1, 0))
            kept = ctx[near] == context if len(ctx) else np.zeros(len(at), bool)
            own = own[into] if len(at) else np.zeros(0)
            self.p[at[kept]] = smoothed(own[kept], n[near[kept]], kinds[near[kept]], self.p[at[kept]])
            self.done[at] = depth
            often = np.full(len(place), np.inf)  # how often a position's context occurs with its symbol, as far as it was asked
            often[at] = own
            # what a hot context is followed by tells how often the next longer context occurs
            known = self.after(np.isfinite(often))
            self.live &= ~(known & (self.done == depth)) | self.after(often > 1)
            self.hot = self.after(np.isfinite(often) & (often > limit)) & (self.done == depth)

    def after(self, flag: np.ndarray) -> np.ndarray:
        """Positions after flagged ones in the same text."""
        out = np.zeros(len(flag), bool)
        out[1:] = flag[:-1]
        return out & (self.place > 0)

    def word(self, at: np.ndarray, back: int) -> np.ndarray:
        """Place among the numbers, from 1 on, of the word so far back; 0 before the text."""
        return np.where(self.place[at] >= back, self.local[np.maximum(at - back, 0)] + 1, 0)

    def hot_pairs(self, depth: int):
        """Positions in hot contexts, their distinct (context, symbol) hashes, each position's place among these, context hashes, and training counts."""
        at = np.flatnonzero(self.hot)
        context = chain([self.numbers[self.local[at - k]] for k in range(1, depth + 1)])
        pairs, _, seen, into = packed.distinct(chain([context, self.numbers[self.local[at]]]), None, self.trained(at))
        return at, pairs, into, context, seen

    def trained(self, at: np.ndarray) -> np.ndarray:
        return self.train[np.searchsorted(self.off, at, "right") - 1]

    def ask_hot(self, depth: int, chunk: int) -> list[tuple]:
        at, pairs, into, context, seen = self.hot_pairs(depth)
        p, whose = np.zeros(len(pairs), np.float32), np.zeros(len(pairs), U)
        p[into], whose[into] = self.p[at], context
        edges = packed.bucket_edges(pairs, self.buckets)
        out = []
        for i, (a, z) in enumerate(zip(edges[:-1], edges[1:])):
            if z > a:
                names, index = np.unique(whose[a:z], return_inverse=True)
                out.append((i, chunk, depth, packed.frame(packed.pack_sorted(pairs[a:z]), packed.pack(seen[a:z].astype(np.uint32)), packed.pack(p[a:z]), packed.pack(names), packed.pack(index.astype(np.uint32)))))
        return out

    def open_positions(self, wave: int):
        """Positions that go to a wave's buckets: the first of each distinct one, each position's place among these, training counts, and the buckets' edges."""
        at = np.flatnonzero(self.live & (self.place > self.done) & (self.done < DEPTH))
        back = [self.word(at, k) for k in range(1, DEPTH + 1)]
        done = self.done[at]
        key = chain([np.where(done >= k, np.append(self.numbers, U(0))[b - 1], U(0)) for k, b in enumerate(back)])  # the nearest done + 1 words
        bucket = (key >> U(32)) * U(self.buckets) >> U(32)
        own = bucket % U(WAVES) == wave
        at, bucket, back = at[own], bucket[own], [b[own] for b in back]
        one = bucket.astype(np.int64) << 42 | back[0] << 21 | back[1]
        two = back[2] << 21 | self.local[at]
        if len(self.numbers) >= 1 << 21 or self.buckets >= 1 << 21:  # a text of that many different words, or so many buckets, is sorted by five keys
            order = np.lexsort((self.local[at], *back[::-1], bucket))
            same = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (bucket, *back, self.local[at])])
        else:
            order = np.lexsort((two, one))
            same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        new = np.append(np.ones(min(len(at), 1), bool), ~same)
        into = np.empty(len(at), np.int64)
        into[order] = np.cumsum(new) - 1
        first = order[new]
        seen = np.bincount(into, self.trained(at), len(first))
        edges = np.searchsorted(bucket[first], np.arange(self.buckets + 1, dtype=U))
        return at, first, into, seen, edges

    def ask_main(self, chunk: int, wave: int) -> list[tuple]:
        at, first, _, seen, edges = self.open_positions(wave)
        at = at[first]
        numbers = np.append(self.numbers, U(0))
        cols = [numbers[self.word(at, k) - 1] for k in range(1, DEPTH + 1)]
        out = []
        for i, (a, z) in enumerate(zip(edges[:-1], edges[1:])):
            if z > a:
                own = at[a:z]
                done, nearest = self.done[own], cols[0][a:z]
                symbols, sym = np.unique(self.local[own], return_inverse=True)
                count = self.count[own[np.unique(sym, return_index=True)[1]]]
                step = small(np.diff(nearest, prepend=U(0)))
                tell = packed.frame(
                    packed.pack_columns(step, *[small(x[a:z]) for x in cols[1:]], sym.astype(np.uint16 if len(symbols) <= 1 << 16 else np.uint32), done, small(seen[a:z].astype(U))),
                    packed.pack_columns(small(np.diff(self.numbers[symbols], prepend=U(0))), small(count.astype(U))),
                    packed.pack_columns(self.p[own[done > 0]].astype(np.float32)),
                )
                out.append((i, chunk, MAIN + wave, tell))
        return out

    def finish(self, answers: list[bytes], wave: int) -> None:
        """Takes the probabilities of a wave's buckets."""
        if not answers:
            return
        at, first, into, _, _ = self.open_positions(wave)
        p, there = np.zeros(len(first)), []
        for x in answers:
            size, bits, _ = packed.unframe(x)
            there.append(np.unpackbits(packed.unpack(bits), count=int.from_bytes(size, "little")))
        there = np.concatenate(there).astype(bool)
        p[there] = np.concatenate([packed.unpack(packed.unframe(x)[2]) for x in answers])
        hit = there[into]
        self.p[at[hit]] = p[into[hit]]


def answer_hot(t: pa.Table) -> pa.Table:
    """One bucket of pairs in hot contexts: the counts asked for, and the contexts' sums (chunk -1)."""
    rows = t.select(["bucket", "chunk", "round", "payload"]).to_pylist()
    parts = [packed.unframe(r["payload"]) for r in rows]
    keys = [packed.unpack_sorted(x[0]) for x in parts]
    pairs, _, total, place = packed.distinct(np.concatenate(keys), None, np.concatenate([packed.unpack(x[1]) for x in parts]))
    p, whose = np.ones(len(pairs)), np.zeros(len(pairs), U)
    p[place] = np.concatenate([packed.unpack(x[2]) for x in parts])
    whose[place] = np.concatenate([packed.unpack(x[3])[packed.unpack(x[4])] for x in parts])
    out, at = [], 0
    for r, k in zip(rows, keys):
        out.append((r["bucket"], r["chunk"], r["round"], packed.pack(small(total[place[at : at + len(k)]]))))
        at += len(k)
    names, index = np.unique(whose, return_inverse=True)
    sums = [np.bincount(index, x, len(names)) for x in (total, total > 0, saved(total, p))]
    return rows_of([*out, (rows[0]["bucket"], -1, rows[0]["round"], packed.frame(packed.pack(names), *map(packed.pack, sums), packed.pack(np.array([total.max()]))))])


def answer_main(total: int):
    def run(t: pa.Table) -> pa.Table:
        """One bucket of positions: their probabilities where a context changed them, in the order asked."""
        rows = t.select(["bucket", "chunk", "round", "payload"]).to_pylist()
        parts, sizes = [], []
        for r in rows:
            (step, second, third, sym, done, seen), (symbols, count), (p,) = map(packed.unpack_columns, packed.unframe(r.pop("payload")))
            sizes.append(len(step))
            parts.append((np.cumsum(step.astype(U)), second, third, np.cumsum(symbols.astype(U))[sym], done, seen, count[sym], p))
        *before, sym, done, seen, count = (np.concatenate([x[k] for x in parts]) for k in range(7))
        p = (count.astype(np.float64) + 1) / total
        p[done > 0] = np.concatenate([x[7] for x in parts])
        del parts, count
        p, changed = grown(done, before, sym, seen, p)
        out, at = [], 0
        for r, n in zip(rows, sizes):
            own = slice(at, at + n)
            out.append((r["bucket"], r["chunk"], r["round"], packed.frame(n.to_bytes(8, "little"), packed.pack(np.packbits(changed[own])), packed.pack(p[own][changed[own]].astype(np.float32)))))
            at += n
        return rows_of(out)

    return run


def hot_states(answers: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """Hashes, tokens and numbers of successors of a round's retained hot contexts; the most frequent pair's count."""

    def sums(batches):
        for b in batches:
            for x in b["payload"].to_pylist():
                names, n, kinds, gain, most = map(packed.unpack, packed.unframe(x))
                yield pa.RecordBatch.from_pydict({"k": pa.array(names.view(np.int64)), "n": pa.array(n), "kinds": pa.array(kinds), "gain": pa.array(gain), "most": pa.array(np.repeat(most.astype(np.int64), len(names)))})

    rows = answers.where("chunk = -1").select("payload").mapInArrow(sums, "k long, n double, kinds double, gain double, most long")
    got = rows.groupBy("k").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds"), F.sum("gain").alias("gain"), F.max("most").alias("most")).toArrow()
    k, n, kinds, gain, most = (got[c].to_numpy() for c in ("k", "n", "kinds", "gain", "most"))
    k, kept = k.view(U), retained(np.maximum(n, 1), kinds, gain)
    order = np.flatnonzero(kept)[np.argsort(k[kept])]
    return (k[order], n[order], kinds[order]), int(most.max(initial=0))


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every text with a suffix tree learned from the rows where `train` holds (null: they don't).

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score, score: base-10 logarithms of the unigram base's
    and of the tree's probability of the whole text, its end included.

    A null or empty text is one token, the end. Repeated rows are scored alike, and count as often as they occur. An
    empty table gives an empty result; with no training text at all every symbol is unknown. Other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(8, -(-size // RANGE_BYTES))
    chunks, wanted, folder = chunked(base, ranges)
    vocab = numbered(wanted, ranges)
    shared.removed(spark, folder)
    n, v, most = vocab.agg(*[F.coalesce(f(c), F.lit(0)) for f, c in ((F.sum, "tokens"), (F.sum, "types"), (F.max, "most"))]).first()
    total, limit, buckets, states = n + v + 1, hot_limit(n), max(8, -(-n // BUCKET_TOKENS)), []
    names = ("bucket", "chunk", "round", "payload")
    answers = vocab.where("chunk >= 0").select(*names)

    def opened(t: pa.Table, found: pa.Table, model) -> tuple[Chunk, dict]:
        by_round: dict[int, list] = {}
        for r in sorted(found.to_pylist(), key=lambda r: r["bucket"]):
            by_round.setdefault(r["round"], []).append(r["payload"])
        return Chunk(t["payload"][0].as_py(), by_round, *model.value), by_round

    def asker(depth: int, model):
        def ask(t: pa.Table, found: pa.Table) -> pa.Table:
            chunk, at = opened(t, found, model)[0], t["chunk"][0].as_py()
            return rows_of(chunk.ask_main(at, depth - MAIN) if depth >= MAIN else chunk.ask_hot(depth, at))

        return ask

    def asked(depth: int) -> DataFrame:
        model = spark.sparkContext.broadcast((total, limit, buckets, list(states)))
        return chunks.drop("ids").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(asker(depth, model), ASKED)

    for depth in range(1, DEPTH + 1):
        if most <= limit:  # no context of that length is hot
            break
        shared.released(spark)
        got = shared.written(asked(depth).groupBy("bucket").applyInArrow(answer_hot, ASKED), f"round{depth}")
        state, most = hot_states(got)
        states.append(state)
        answers = answers.union(got.where("chunk >= 0"))
    known = answers
    for wave in range(WAVES):
        shared.released(spark)
        got = shared.written(asked(MAIN + wave).groupBy("bucket").applyInArrow(answer_main(total), ASKED), f"tree{wave}")
        known = known.union(got)
    answers, model = known, spark.sparkContext.broadcast((total, limit, buckets, states))
    shared.released(spark)

    def score(t: pa.Table, found: pa.Table) -> pa.Table:
        c, by_round = opened(t, found, model)
        for wave in range(WAVES):
            c.finish(by_round.get(MAIN + wave, []), wave)
        add = lambda x: pa.array(np.add.reduceat(x, c.off[:-1]))  # noqa: E731  every text has a token, its end
        ids = t["ids"].combine_chunks().flatten()
        return pa.table({"id": ids, "held_out": pa.array(~c.train), "n_tokens": pa.array(np.diff(c.off), pa.int64()), "n_known": add((c.count > 0).astype(np.int64)), "train_tokens": pa.array(np.full(len(ids), n, np.int64)), "base_score": add(np.log10((c.count + 1) / total)), "score": add(np.log10(c.p))})

    kind = base.schema["id"].dataType.simpleString()
    out = chunks.groupBy("chunk").cogroup(answers.select("chunk", "bucket", "round", "payload").groupBy("chunk")).applyInArrow(score, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def op1(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document scored by a tree learned from those whose crc32 of the id leaves no remainder of 2 by 7."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = F.coalesce(docs["doc_id"].cast("string"), F.lit(""))
    return score_texts(docs, F.crc32(key.cast("binary")) % 7 != 2)
