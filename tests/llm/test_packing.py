"""Packing: exact token round trip, gapless sequences, and as few as one-at-a-time best fit."""

import zlib

import numpy as np
import pytest

from loomspan.llm import packing


def one_by_one(sizes, length):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(length - s)
    return len(gaps)


def test_plan_is_best_fit_decreasing():
    rnd = np.random.default_rng(2)
    for _ in range(40):
        length = int(rnd.integers(5, 60))
        sizes = rnd.integers(1, length + 1, int(rnd.integers(1, 120)))
        counts = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True))}
        used, seen = {}, 0
        plan = sorted(packing.best_fit(counts, length))
        for s, n in counts.items():
            own = [p for p in plan if p[0] == s]
            for rank in range(n):
                p = [x for x in own if x[1] <= rank][-1]
                j = rank - p[1]
                used.setdefault(p[2] + j // p[3], []).append((p[4] + j % p[3] * s, s))
                seen += 1
        for parts in used.values():
            at = 0
            for off, s in sorted(parts):
                assert off == at
                at += s
            assert at <= length
        assert seen == len(sizes) and len(used) == one_by_one(sizes.tolist(), length)


@pytest.mark.parametrize("length", [64, 2048])
def test_documents(make, corpus, length):
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(packing.default_tokenizer()[0])
    rows = corpus + [(300, "日本語 text ½ 🙂 ٣"), (301, "a <|endoftext|> b")]
    got = [r.asDict() for r in packing.pack_documents(make(rows), length, ids=True).collect()]
    want = sorted([*vocabulary.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows)
    made, open_ = [], {}
    for r in sorted(got, key=lambda r: (str(r["doc_id"]), r["start"], r["sequence_id"])):
        assert zlib.crc32(np.array(r["ids"], "<u4")) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= length
        assert r["piece"] == 0 or r["length"] == length
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, parts in by_doc.items():
        if sum(1 for k, _ in rows if k == i) == 1:
            parts.sort(key=lambda r: r["piece"])
            assert [r["piece"] for r in parts] == list(range(len(parts))) and all(r["start"] == sum(p["length"] for p in parts[:k]) for k, r in enumerate(parts))
            made.append(sum((r["ids"] for r in parts), []))
    assert all(m in want for m in made) and sum(r["length"] for r in got) == sum(map(len, want))
    for r in got:
        open_.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in open_.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= length
    assert len(open_) == one_by_one([r["length"] for r in got], length)


def test_empty(make):
    assert packing.pack_documents(make([])).collect() == []
