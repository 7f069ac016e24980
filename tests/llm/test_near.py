"""Near copies against all pairs."""

import re

import pytest

from loomspan.llm import near

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size, similarity):
    own = [SPLIT.findall((t or "").translate(FOLD)) for _, t in rows]
    sets = [frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset() for w in own]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and both >= similarity * (len(a) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    group = {}
    for i, (k, _) in enumerate(rows):
        group.setdefault(find(i), []).append(k)
    least = {g: min((k for k in ks if k is not None), default=None) for g, ks in group.items()}
    return sorted(((k, least[find(i)], links[i]) for i, (k, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("size", "similarity"), [(5, 0.8), (2, 0.6)])
def test_all_pairs(make, corpus, size, similarity):
    out = near.near_duplicates(make(corpus), size, similarity)
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in out.collect()), key=str) == brute(corpus, size, similarity)


def test_large_group_in_blocks(make, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 4)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[: 60 + i] + [f"own{i}"] + base[60 + i :])) for i in range(40)] + [(99, "else " * 3)]
    out = near.near_duplicates(make(rows))
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in out.collect()), key=str) == brute(rows, 5, 0.8)


def test_empty_table_and_ids_of_text(make):
    assert near.near_duplicates(make([])).collect() == []
    assert [tuple(r)[:3] for r in near.near_duplicates(make([("b", "x y z"), ("a", "x y z")], "string")).orderBy("doc_id").collect()] == [("a", "a", 1), ("b", "a", 1)]


def test_depth():
    for s in (0.5, 0.8, 0.95):
        d = near.depth_for(s)
        assert d == 1 or 1 - (1 - s**d) ** near.TREES >= near.RECALL
