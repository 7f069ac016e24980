"""Vectorised words against regular expressions."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import packed, words

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
texts = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aAbé   \t\n\x0b\x1cZß."), max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(texts, st.booleans())
def test_words_and_hashes(rows, lower):
    w = words.scan(pa.array(rows, pa.string()), lower)
    want = [SPLIT.findall((t or "").translate(FOLD) if lower else t or "") for t in rows]
    assert list(w.counts) == [len(x) for x in want]
    flat = [x for own in want for x in own]
    seen = {}
    for x, h in zip(flat, w.hash):
        assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)
    at, h = words.windows(w, 3)
    grams = [tuple(own[i : i + 3]) for own in want for i in range(len(own) - 2)]
    assert len(grams) == len(at) and len(set(grams)) == len(set(h.tolist()))


def test_slices_of_arrays_and_large_inputs():
    whole = pa.array(["x y", "long " * 700_000, "z", None, "x y"])
    w = words.scan(whole.slice(1))
    assert list(w.counts) == [700_000, 1, 0, 2] and len(set(w.hash[:700_000].tolist())) == 1
    batch = pa.RecordBatch.from_arrays([whole], ["text"])
    assert [b.num_rows for b in words.slices(batch, most=10)] == [1, 1, 3]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packing(values):
    a = np.sort(np.array(values, np.uint64))
    assert (packed.unpack_sorted(packed.pack_sorted(a)) == a).all() and (packed.unpack(packed.pack(a)) == a).all()
    edges = packed.bucket_edges(a, 7)
    assert edges[0] == 0 and edges[-1] == len(a) and all(int(x) * 7 >> 64 == b for b in range(7) for x in a[edges[b] : edges[b + 1]])


def test_words_that_a_polynomial_hash_confuses():
    """A Thue-Morse word and its complement agree in every polynomial hash modulo 2**64."""
    one = "a"
    while len(one) < 4096:
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    for n in (8, 64, 1024, 4096):
        w = words.scan(pa.array([f"{one[:n]} {other[:n]} {one[:n]}"]))
        assert w.hash[0] == w.hash[2] != w.hash[1] and (w.again(1) != w.hash).all()


def test_words_with_zero_bytes_and_of_all_lengths():
    own = ["x" * n + tail for n in range(300) for tail in ("", "\0", "\0\0", "y")]
    w = words.scan(pa.array([" ".join(x for x in own if x)]))
    assert len(set(w.hash.tolist())) == len(own) - 1 == len(w.hash)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**16 - 1), st.floats(0, 1, width=32)), max_size=30))
def test_packing_of_columns(rows):
    cols = [np.array([r[k] for r in rows], kind) for k, kind in enumerate((np.uint64, np.uint16, np.float32))] + [np.arange(len(rows), dtype=np.uint8)]
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(cols, packed.unpack_columns(packed.pack_columns(*cols)), strict=True))
