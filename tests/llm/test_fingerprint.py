"""Fingerprints and the next document against plain Python."""

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from loomspan.llm import fingerprint


def canon(t):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t or "").upper().lower().replace("ς", "σ")).strip()


def test_equal_forms_have_equal_fingerprints(make, corpus):
    rows = corpus + [(200, "ﬁne CAFÉ"), (201, "fine  café"), (202, "Straße"), (203, "STRASSE"), (204, "x" * 300_000)]
    got = fingerprint.fingerprints(make(rows)).collect()
    by_text = {}
    for r in got:
        assert by_text.setdefault(canon(r["text"]), r["fingerprint"]) == r["fingerprint"]
        assert len(r["fingerprint"]) == 32
    assert len(set(by_text.values())) == len(by_text) and len(got) == len(rows)
    named = {r["doc_id"]: r["fingerprint"] for r in got}
    assert named[200] == named[201] and named[202] == named[203]


def test_collisions_are_told_apart_by_bytes(spark, make, monkeypatch):
    monkeypatch.setattr(fingerprint, "wide_hash", lambda form: F.lit("0" * 32))
    got = {r["text"]: r["fingerprint"] for r in fingerprint.fingerprints(make([(1, "a"), (2, "b"), (3, "a"), (4, None)])).collect()}
    assert len(set(got.values())) == 3


@pytest.mark.parametrize("rows", [3, 4096])
def test_next(make, corpus, monkeypatch, rows):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", rows)
    monkeypatch.setattr(fingerprint.id_ranges, "__defaults__", (rows,))
    docs = make(corpus).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = sorted(((i, t or "") for i, t in corpus), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = sorted(((i, t, own[(k + 1) % len(own)][1]) for k, (i, t) in enumerate(own)), key=str)
    assert sorted((tuple(r) for r in fingerprint.with_next(docs, "doc_id", ("text",)).select("doc_id", "text", "next_text").collect()), key=str) == want


def test_one_row_and_none(make):
    one = make([(5, "abcd")]).select("doc_id", "text")
    assert fingerprint.with_next(one, "doc_id", ("text",)).first()["next_text"] == "abcd"
    assert fingerprint.with_next(make([]).select("doc_id", "text"), "doc_id", ("text",)).collect() == []
    assert fingerprint.fingerprints(make([])).collect() == []


@pytest.mark.parametrize("rows", [4, 4096])
def test_ids_that_are_strings(make, monkeypatch, rows):
    monkeypatch.setattr(fingerprint.id_ranges, "__defaults__", (rows,))
    ids = ["b", 'a"q', "10", "9", "c,d", "é", "", None, "a\\z", "b"]
    docs = make([(i, f"text {k}") for k, i in enumerate(ids)], "string").select("doc_id", "text")
    own = sorted(((i, f"text {k}") for k, i in enumerate(ids)), key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    want = sorted(((i, t, own[(k + 1) % len(own)][1]) for k, (i, t) in enumerate(own)), key=str)
    assert sorted((tuple(r) for r in fingerprint.with_next(docs, "doc_id", ("text",)).select("doc_id", "text", "next_text").collect()), key=str) == want


def test_query_against_plain_python(spark, make, corpus, tmp_path):
    rows = [(i, t) for i, t in dict(corpus).items() if i is not None] + [(300, "é" * 7), (301, "Ab\U0001f600cd\U0001f601")]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    own = sorted((i, t or "") for i, t in rows)
    got = {r["doc_id"]: r for r in fingerprint.op4(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    edited = {}
    for k, (i, t) in enumerate(own):
        cut = len(t) // 4
        edited[i] = t[: len(t) - cut] + own[(k + 1) % len(own)][1][:cut]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited[i].encode()).hexdigest()
    forms = {}
    for k, (i, t) in enumerate(own):
        assert forms.setdefault(canon(t), got[i]["fingerprint"]) == got[i]["fingerprint"]
        assert forms.setdefault(canon(edited[i]), got[i]["edited_fingerprint"]) == got[i]["edited_fingerprint"]
        assert got[i]["near_edited"] == float(canon(t) == canon(edited[i])) and got[i]["near_next"] == float(canon(t) == canon(own[(k + 1) % len(own)][1]))
    assert len(set(forms.values())) == len(forms)
