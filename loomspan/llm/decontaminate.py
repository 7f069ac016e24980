"""Benchmark decontamination by a prefix-filtered join, in DataFrame operations only.

An item's window is a run of its words; a document is contaminated if a window of some item occurs in it whole. Words
are ordered by their number of occurrences in the documents. For whole containment the prefix that a match must share
is one token: the window's rarest word. So document words meet only the rarest words of the windows, and a meeting gives
the place where the window would have to start; the place must lie in the document with the window's whole length
(positional and length bounds), and then the words are compared exactly.

The rarest words of a benchmark are broadcast if there are at most BROADCAST_ROWS of them; the comparison then takes
place in the scan of the documents, without a shuffle of their texts. With more, words and prefixes meet in a shuffled
join and the texts of documents with candidates are joined back.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Prefix rows that may be broadcast (about 150 bytes each).
BROADCAST_ROWS = 200_000
#: What separates words once A-Z are folded, and in the text as it is.
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column, fold: bool = True) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text, A-Z lower-cased if `fold`; none for null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    if not fold:
        return F.array_remove(F.split(text, _RAW_SEPARATORS), "")
    return F.array_remove(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), _SEPARATORS), "")


def item_windows(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct (item_id, win, len): each `size`-word window of an item as a string, or the whole of a shorter item."""
    own = items.select(items[id_col].alias("item_id"), words_of(items[text_col]).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    win = F.transform(starts, lambda i: F.concat_ws(" ", F.slice("w", i, size)))
    return own.where(F.size("w") > 0).select("item_id", F.least(F.size("w"), F.lit(size)).alias("len"), F.explode(win).alias("win")).distinct()


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Where windows occur: distinct (row_key, start, len, win). `docs` has row_key and text, `windows` distinct win and len."""
    tokens = windows.select("win", "len", F.posexplode(F.split("win", " ")).alias("p", "word"))
    asked = tokens.select("word").distinct()
    n_asked = asked.count()
    seen = docs.select(F.explode(words_of(docs["text"])).alias("word"))
    common = seen.join(F.broadcast(asked) if n_asked <= BROADCAST_ROWS else asked, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    prefixes = tokens.join(common, "word").groupBy("win", "len").agg(F.min(F.struct("n", "word", "p")).alias("rare"), F.count("*").alias("known"))
    prefixes = prefixes.where("known = len").select("win", "len", F.col("rare.word").alias("word"), F.col("rare.p").alias("p"))
    small = n_asked <= BROADCAST_ROWS and windows.count() <= BROADCAST_ROWS
    own = docs.select("row_key", words_of(docs["text"]).alias("w"))
    bounds = (F.col("pos") >= F.col("p")) & (F.col("pos") - F.col("p") + F.col("len") <= F.col("n"))
    same = F.concat_ws(" ", F.slice("w", F.col("start") + 1, F.col("len"))) == F.col("win")
    if small:
        placed = own.select("row_key", "w", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word")).join(F.broadcast(prefixes), "word").where(bounds)
        return placed.withColumn("start", F.col("pos") - F.col("p")).where(same).select("row_key", "start", "len", "win").distinct()
    placed = own.select("row_key", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word")).join(prefixes, "word").where(bounds)
    candidates = placed.select("row_key", (F.col("pos") - F.col("p")).alias("start"), "len", "win").distinct()
    return own.join(candidates, "row_key").where(same).select("row_key", "start", "len", "win").distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: id, row_key, n_words, n_hit (words inside an occurrence of a window), item_ids (sorted as strings).

    Null, empty and wordless texts have no words and no hits, and such items no windows. Repeated documents are each
    judged alike; repeated items, or items that share windows, are each reported by id, null ids are not. Empty tables
    give no hits. Other columns are ignored. row_key is a 128-bit hash of id and text.
    """
    base = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).withColumn("row_key", shared.row_key("id", "text"))
    windows = item_windows(items, size, item_id, item_text)
    found = shared.written(hits(base, windows.select("win", "len").distinct()), "hits")
    spans = found.groupBy("row_key").agg(F.collect_set(F.struct("start", "len")).alias("spans"))
    spans = spans.select("row_key", F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))).alias("n_hit"))
    owners = found.select("row_key", "win").distinct().join(windows.select("win", F.col("item_id").cast("string").alias("item")), "win").groupBy("row_key").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    rows = base.select("id", "row_key", F.size(words_of(F.col("text"), fold=False)).alias("n_words"))
    out = rows.join(spans.join(owners, "row_key", "left"), "row_key", "left")
    return out.select(F.col("id").alias(id_col), "row_key", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def op2(spark, sf_dir: str) -> DataFrame:
    """Contract query: each document's contamination by the benchmark."""
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS_SQL = "list_filter(string_split_regex(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL.format("text")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win, least(len(w), 10) AS n
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw))),
h AS (SELECT dw.doc_id, dw.i, dw.n, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN o ON d.doc_id = o.doc_id
"""
