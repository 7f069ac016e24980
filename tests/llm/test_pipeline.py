"""Each stage of the pipeline against brute force on its own input, and the whole run."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspan.llm import packing

from . import test_decontaminate as decontaminate_tests
from . import test_near as near_tests
from . import test_substring as substring_tests
from .conftest import prose

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "__extra", "row_key", "kept", "n_words", "good", "__row_key"]


@pytest.fixture(scope="module")
def tables(spark, corpus, tmp_path_factory):
    sf = tmp_path_factory.mktemp("sf")
    rnd = random.Random(8)
    rows = [*corpus, *[(i, " ".join(rnd.choice(["idiot", "moron", "clown"]) if k % 5 == 0 else w for k, w in enumerate(prose(rnd, 60).split(" ")))) for i in range(400, 460)]]
    rows += [(i, prose(rnd, 60)) for i in range(500, 640)]
    docs = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), 1.5, 7, "k", 3, None, 4) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __extra double, row_key long, kept string, n_words int, good int, __row_key int")
    docs.write.parquet(str(sf / "documents.parquet"))
    texts = dict(corpus)
    items = [(1, " ".join(texts[20].split()[:30])), (2, None), (3, " ".join(texts[500 - 380].split()[2:14]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(sf / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, int(400 <= i < 460)) for i, _ in rows if i is not None and i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(str(sf / "labels.parquet"))
    return str(sf), spark.read.parquet(str(sf / "documents.parquet")), items


def rows_of(df):
    assert df.columns == COLUMNS
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_quality(spark, tables):
    sf, docs, _ = tables
    kept = {i for i, _ in rows_of(STAGES["quality classifier"](spark, docs, sf))}
    toxic, clean = set(range(400, 460)), set(range(500, 640))
    assert not kept & toxic and clean <= kept


def test_near_duplicates(spark, tables):
    sf, docs, _ = tables
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, seen = [], set()
    groups = {}
    for (i, t), (k, least, _) in zip(sorted(rows, key=str), sorted(near_tests.brute(rows, 5, 0.8), key=str)):
        groups.setdefault(k, set()).add(least)
    for i, t in sorted(set(rows), key=str):
        if not (t or "").split():
            want.append((i, t))
        elif i is not None and groups[i] == {i}:
            want.append((i, t))
    got = rows_of(STAGES["n-gram Jaccard join"](spark, docs, sf))
    assert len(got) == len(set(got))
    assert sorted((r for r in got if r[0] is not None), key=str) == sorted((r for r in want if r[0] is not None), key=str)
    assert {t for i, t in got if i is None} == {t for i, t in rows if i is None}


def test_substring(spark, tables):
    sf, docs, _ = tables
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(((i, kept) for i, n, gone, kept in substring_tests.brute(rows, 35) if not (gone and not kept)), key=str)
    out = STAGES["substring dedup"](spark, docs, sf)
    assert sorted(rows_of(out), key=str) == want
    assert out.where("text <> '' AND n_chars <> length(text)").isEmpty()


def test_decontamination(spark, tables):
    sf, docs, items = tables
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    hit = {i for i, _, n, _ in decontaminate_tests.brute(rows, items, 10) if n}
    assert hit
    assert sorted(rows_of(STAGES["benchmark decontamination"](spark, docs, sf)), key=str) == sorted((r for r in rows if r[0] not in hit), key=str)


def test_whole_run_and_empty_tables(spark, tables):
    sf, docs, _ = tables
    left = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        left = stage(spark, left, sf)
    texts = [r["text"] for r in left.select("text").collect()]
    out = corpus_pipeline.run(spark, sf)
    tokens = sum(len(packing.encode(t or "", *packing.default_tokenizer())) + 1 for t in texts)
    total = out.agg(F.sum("length"), F.countDistinct("sequence_id"), F.sum("ids_crc32")).first()
    assert total[0] == tokens and total[1] >= -(-tokens // 2048)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).collect() == []
