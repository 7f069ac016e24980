"""Repeat removal against counting all windows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from loomspan.llm import substring

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    own = [SPLIT.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + width]) for w in own for i in range(len(w) - width + 1))
    out = []
    for (i, t), w in zip(rows, own):
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            if count[tuple(w[j : j + width])] > 1:
                gone[j : j + width] = [True] * width
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else t or ""))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [35, 8])
def test_brute_force(make, corpus, width):
    got = substring.remove_repeats(make(corpus), width, carry=("row_key", "kept")).drop("row_key")
    assert got.columns == ["doc_id", "kept", "n_words", "n_removed", "kept"]
    assert sorted(((r[0], r[2], r[3], r[4]) for r in got.collect()), key=str) == brute(corpus, width)


def test_empty_table(make):
    assert substring.remove_repeats(make([])).collect() == []


def test_symbols_depend_on_no_more_than_their_range():
    rnd = random.Random(4)
    for _ in range(200):
        core = [rnd.randrange(1, 5) for _ in range(40)]
        made = []
        for _ in range(2):
            left, right = ([rnd.randrange(1, 5) for _ in range(rnd.randrange(0, 9))] for _ in range(2))
            names = np.array(left + core + right, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            name, lo, hi = substring.recompress(names, np.array([0, len(names)]))
            inside = (lo >= len(left)) & (hi <= len(left) + 40)
            made.append({(int(a), int(b) - len(left), int(c) - len(left)) for a, b, c in zip(name[inside], lo[inside], hi[inside])})
        assert made[0] == made[1]


def test_long_words_that_a_polynomial_hash_confuses(make):
    """Two texts equal but for one word of 1024 letters share only the windows that miss it."""
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    ends = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*ends[:20], word, *ends[20:]])) for i, word in enumerate((one, one.translate(str.maketrans("ab", "ba"))))]
    for width in (35, 8):
        got = sorted(tuple(r) for r in substring.remove_repeats(make(rows), width).collect())
        assert got == brute(rows, width)
