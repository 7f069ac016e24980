"""Resampling on held-out labels, and its pieces against plain computation."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan.llm import quality

from .conftest import prose


@pytest.fixture(scope="module")
def labelled(spark, make):
    rnd = random.Random(2)
    rows, labels, kind = [], [], {}
    for i in range(900):
        bad = rnd.random() < 0.3
        toxic = bad and rnd.random() < 0.5
        words = prose(rnd, rnd.randrange(5, 120)).split(" ")
        if toxic:
            for _ in range(4):
                words[rnd.randrange(len(words))] = rnd.choice(["idiot", "moron"])
        elif bad:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        kind[i] = bad
        if i % 3:
            labels.append((i, int(not bad or toxic), int(toxic)))
    rows += [(1000, None), (1001, ""), (0, rows[0][1])]
    labels += [(None, 1, 0), (5000, 1, 0), (7, None, 0)]
    return make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), kind, rows


def test_held_out_accuracy(labelled):
    docs, labels, kind, rows = labelled
    out = quality.resample(docs, labels, scores=False)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    held = [i for i in kind if i % 3 == 0]
    assert np.mean([i in kept for i in held if not kind[i]]) > 0.95 and np.mean([i in kept for i in held if kind[i]]) < 0.05
    assert {1000, 1001} <= kept


def test_without_both_kinds_all_are_drawn(labelled, spark):
    docs, labels, _, rows = labelled
    assert quality.resample(docs, labels.where("quality = 1 AND toxic = 0")).count() == len(rows)
    assert quality.resample(docs, labels.limit(0)).count() == len(rows)
    assert quality.resample(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("few", [5, 100_000])
def test_kth_largest(spark, few):
    rnd = np.random.default_rng(3)
    values = np.concatenate([rnd.normal(size=3000), np.full(50, 0.25), [-1e9, 1e9]])
    df = spark.createDataFrame([(float(v),) for v in values], "x double").cache()
    for k in (0, 1, 7, 1500, 3052, 9999):
        want = np.inf if k == 0 else -np.inf if k >= len(values) else np.sort(values)[-k]
        assert quality.kth_largest(df, "x", k, few) == want


def test_gumbel_top_k_draws_by_weight(spark):
    """Of many ids with two weights the heavier are drawn in proportion."""
    df = spark.range(20_000).withColumn("w", F.when(F.col("id") % 2 == 0, F.log(F.lit(3.0))).otherwise(0.0))
    noise = -F.log(-F.log((F.pmod(F.xxhash64(F.lit(17), F.col("id").cast("long"), F.lit("t")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))))
    top = df.withColumn("key", F.col("w") + noise).orderBy(F.desc("key")).limit(500)
    share = top.where("id % 2 = 0").count() / 500
    assert 0.69 < share < 0.81


def test_raw_model_counts_unlabelled_documents(make, spark):
    """A language that no label speaks of, and pairs of words, are in the raw model, and the language weighs against a text."""
    rows = [(i, "plain words of a good text") for i in range(300)] + [(i, "fremde Rede voller Laute hier") for i in range(300, 900)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    out, _, _ = quality.weighted(make(rows).select("doc_id", "text"), labels)
    weight = {r["c0"]: r["log_weight"] for r in out.collect()}
    assert weight[250] > 0 > weight[500]
    once, again = (quality.features(pa.array([x]))[0] for x in ("alpha beta gamma", "beta alpha gamma"))
    assert set(once) != set(again)
