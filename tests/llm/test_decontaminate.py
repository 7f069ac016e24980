"""Contamination against looking for every window, with the items broadcast and not."""

import re

import pytest

from loomspan.llm import decontaminate

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, items, size):
    split = lambda t: SPLIT.findall((t or "").translate(FOLD))
    windows = {}
    for i, t in items:
        w = split(t)
        for j in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[j : j + size]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, ids = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[j : j + n]))) is not None:
                    hit.update(range(j, j + n))
                    ids |= {str(x) for x in found if x is not None}
        out.append((i, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_broadcast", [200_000, 0])
def test_brute_force(spark, make, corpus, monkeypatch, rows_broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows_broadcast)
    texts = dict(corpus)
    items = [(1, " ".join(texts[5].split()[3:20])), (10, texts[3].upper()), (2, "A, b! c-D"), (2, "A, b! c-D"), (3, None), (4, "..."), (5, "run " * 12), (6, " ".join(texts[140].split()[:40])), (None, texts[7]), (11, "nowhere at all to be found in any of these texts here")]
    found = decontaminate.contamination(make(corpus), spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, win string"))
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in found.collect()), key=str) == brute(corpus, items, 10)


def test_empty_tables(spark, make, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.contamination(make(corpus), none).collect()
    assert len(out) == len(corpus) and all(r["n_hit"] == 0 and r["item_ids"] == [] for r in out)
    assert decontaminate.contamination(make([]), spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []


def test_no_python_on_the_main_path(make, corpus, spark):
    plan = decontaminate.contamination(make(corpus), spark.createDataFrame([(1, "a b")], "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
