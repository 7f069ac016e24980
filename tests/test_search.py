"""BM25 and nearest neighbours against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomspan.errors import InvalidSpec, StaleIndex
from loomspan.operators import predicates, records, text, vector


def scorer(docs, query, weights=None, only=None, k1=1.2, b=0.75):
    own = {i: {f: [w for w in "".join(c if c.isalnum() or c == "_" else " " for c in t.lower()).split()] for f, t in fs.items() if weights is None or f in weights} for i, fs in docs.items()}
    length = {i: sum(map(len, fs.values())) for i, fs in own.items()}
    length = {i: n for i, n in length.items() if n}
    avg = sum(length.values()) / len(length)
    out = {}
    for term in sorted(set(query.lower().split())):
        df = sum(any(term in ws for ws in own[i].values()) for i in length)
        idf = math.log((len(length) - df + 0.5) / (df + 0.5) + 1)
        for i in length:
            for f, ws in own[i].items():
                tf = ws.count(term)
                if tf and (only is None or f in only):
                    w = (weights or {}).get(f, 1.0)
                    out[i] = out.get(i, 0) + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[i] / avg)) * w
    return sorted(((i, s) for i, s in out.items() if s > 0), key=lambda x: (-round(x[1], 9), x[0]))


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(5)
    docs = {i: {"title": " ".join(rnd.choices(["secure", "mesh", "plain", "note"], k=3)), "body": " ".join(rnd.choices(["routing", "trust", "mesh", "local", "x_y", "z9"], k=rnd.randrange(0, 9)))} for i in range(60)}
    docs[60], docs[61] = {"title": "", "body": ""}, docs[3]
    return docs, spark.createDataFrame([(i, f) for i, f in docs.items()], "id long, fields map<string,string>").cache()


@pytest.mark.parametrize(("weights", "only"), [(None, None), ({"title": 2.0, "body": 0.5}, None), ({"title": 1.0}, None), ({"title": 2.0, "body": 1.0}, ["body"]), ({"title": 0.0, "body": 1.0}, None)])
def test_scores(corpus, weights, only):
    docs, df = corpus
    config = text.collection_config(weights)
    got = [(r["id"], r["score"]) for r in text.search(df, "Mesh routing absent", {"fields": only, "limit": 100}, config, digits=9).collect()]
    want = scorer(docs, "mesh routing absent", weights, only)
    assert [i for i, _ in got] == [i for i, _ in want] and all(abs(a - b) < 1e-6 for (_, a), (_, b) in zip(got, want))


def test_pages_hits_snippets(corpus):
    docs, df = corpus
    whole = [r["id"] for r in text.search(df, "mesh trust", {"limit": None}, digits=9).collect()]
    assert [r["id"] for r in text.search(df, "mesh trust", {"offset": 3, "limit": 4}, digits=9).collect()] == whole[3:7]
    hit = text.search(df, "mesh trust", {"limit": 1, "explain": True, "includeSnippets": True}, digits=9).first()
    assert all(h["terms"] == sorted(set(h["terms"])) for h in hit["hits"]) and abs(sum(h["score"] for h in hit["hits"]) - hit["score"]) < 1e-6
    assert [s["field"] for s in hit["snippets"]] == ["body", "title"] and hit["explain"].startswith("bm25")
    assert text.search(df, "...", {"limit": 5}).isEmpty()
    with pytest.raises(InvalidSpec):
        text.search(df, "x", {"limit": 0})
    row = text.stats(df).first()
    assert row["documents"] == sum(any(f.values()) for f in docs.values())


def test_candidates(spark, corpus):
    rows = spark.createDataFrame([(0, "a", {"t": "one"}), (1, "b", {"t": "two"}), (2, "a", {"t": "three"})], "ordinal int, id string, fields map<string,string>")
    got = {r["id"]: (r["ordinal"], r["fields"]["t"]) for r in text.candidates(rows).collect()}
    assert got == {"a": (0, "three"), "b": (1, "two")}
    assert {r["id"] for r in text.candidates(rows, {"candidateLimit": 1}).collect()} == {"a"}
    with pytest.raises(InvalidSpec):
        text.candidates(rows, None, preselected=True)
    json_rows = spark.createDataFrame([('{"a": {"b": ["x", {"c": "y"}]}, "d": "z", "e": 1}',)], "v string")
    assert json_rows.select(text.string_leaves(json_rows["v"])).first()[0] == {"a.b.0": "x", "a.b.1.c": "y", "d": "z"}
    assert json_rows.select(text.string_leaves(json_rows["v"], ["a", "a.b.1.c", "none"])).first()[0] == {"a": "x y", "a.b.1.c": "y"}


def test_terms():
    assert text.terms_of("Secure mesh-routing, v2") == ["mesh", "routing", "secure", "v2"]


def test_vectors(spark):
    rows = [("alpha", [1.0], "keep"), ("beta", [1.0], "keep"), ("far", [5.0], "keep"), ("zero", [0.0], "drop"), ("none", None, "keep")]
    df = spark.createDataFrame(rows, "id string, embedding array<float>, tag string")
    got = vector.search(df, [0.0], {"limit": 2, "filter": {"ids": ["far", "alpha", "beta"], "metadata": {"eq": {"tag": "keep"}}}}, metadata={"tag": "tag"}).collect()
    assert [(r["id"], r["distance"]) for r in got] == [("alpha", 1.0), ("beta", 1.0)]
    assert [r["id"] for r in vector.search(df, [1.0], {"limit": 9, "filter": {"idPrefix": "z"}}).collect()] == ["zero"]
    assert {r["id"]: r["distance"] for r in vector.search(df, [2.0], {"limit": 9}, "cosine").collect()} == {"alpha": 0.0, "beta": 0.0, "far": 0.0, "zero": 1.0}
    assert vector.search(df, [2.0], {"limit": 1}, "dot").first()["distance"] == -10.0
    wide = df.unionByName(spark.createDataFrame([("wide", [1.0, 2.0], "keep")], df.schema))
    with pytest.raises(Exception, match="dimension 2, expected 1"):  # a stored vector of another dimension isn't hidden
        vector.search(wide, [2.0], {"limit": 9}).collect()
    for bad in (([1.0, 2.0], 1, 1), ([math.inf], 1, 1), ([1.0], 1, 0)):
        with pytest.raises(InvalidSpec):
            vector.validated(*bad)


def test_vector_chunks(spark):
    items = spark.createDataFrame([("a", 3, 2, False), ("b", 3, 2, False), ("c", 1, 1, True)], "id string, dim int, n_chunks int, deleted boolean")
    chunks = spark.createDataFrame([("a", 1, [3.0]), ("a", 0, [1.0, 2.0]), ("a", 0, [1.0, 2.0]), ("b", 0, [1.0])], "id string, n int, values array<double>")
    got = vector.assemble_chunks(items, chunks)
    assert {r["id"]: (r["state"], r["embedding"]) for r in got.collect()} == {"a": ("complete", [1.0, 2.0, 3.0]), "b": ("incomplete", None), "c": ("deleted", None)}
    assert tuple(vector.stats(got).first()) == (1, 1, 1)


def test_pages_of_a_billion_rows(spark):
    """A limit far beyond the rows allocates nothing by its number."""
    big = 1_000_000_000
    rows = spark.range(5000).select(F.format_string("k%05d", "id").alias("key"), F.lit("json").alias("kind"), F.lit("1").alias("json"), F.lit(None).cast("binary").alias("bytes"))
    assert records.scan(rows, {"limit": big}).count() == 5000 and records.next_cursor(rows, {"limit": big}) is None
    assert [r["key"] for r in predicates.paged(rows, [F.desc("key")], 4997, big).collect()] == ["k00002", "k00001", "k00000"]
    assert predicates.paged(rows, [F.asc("key")], big, 5).count() == 0 and predicates.paged(rows, [F.asc("key")], 10).count() == 4990
    vectors = spark.range(50).select(F.col("id"), F.array(F.col("id").cast("double")).alias("embedding"))
    assert [r["id"] for r in vector.search(vectors, [0.0], {"limit": big}).collect()] == list(range(50))
    docs = spark.range(50).select("id", F.create_map(F.lit("text"), F.lit("same word")).alias("fields"))
    assert [r["id"] for r in text.search(docs, "word", {"limit": big, "offset": 45}).collect()] == [45, 46, 47, 48, 49]


def test_pages_beyond_the_heap_are_cut_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(predicates, "TOP_K", 10)
    rows = spark.range(1000).repartition(7).withColumn("by", F.col("id") % 10)
    want = sorted(((i % 10, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
    for offset, limit in ((0, 500), (95, 20), (990, 50), (5, None), (2000, 3)):
        got = predicates.paged(rows, [F.desc("by"), F.asc("id")], offset, limit).collect()
        assert [(r["by"], r["id"]) for r in got] == want[offset : None if limit is None else offset + limit]


def test_stored_text_index(spark, tmp_path):
    """A search of stored postings ranks as one of the documents; each policy sees that the source has changed."""
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([(i, {"title": f"word{i % 3} mesh", "body": "routing " * (i % 4)}) for i in range(30)], "id long, fields map<string,string>")
    config = text.collection_config({"title": 2.0, "body": 1.0})
    want = [tuple(r) for r in text.search(docs, "mesh routing word1", {"limit": 7}, config).select("id", F.round("score", 9)).collect()]
    assert [tuple(r) for r in text.search_stored(docs, path, "mesh routing word1", {"limit": 7}, config).select("id", F.round("score", 9)).collect()] == want
    more = docs.unionByName(spark.createDataFrame([(99, {"title": "word1", "body": "mesh mesh"})], docs.schema))
    assert 99 not in {r["id"] for r in text.search_stored(more, path, "mesh", {"stalePolicy": "allow"}, config).collect()}
    with pytest.raises(StaleIndex):
        text.search_stored(more, path, "mesh", {"stalePolicy": "reject"}, config)
    assert 99 in {r["id"] for r in text.search_stored(more, path, "mesh", {}, config).collect()}
