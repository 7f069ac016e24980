"""Archives: exact round trips, roles against plain Python, and foreign archives."""

import gzip
import hashlib

from loomspan.llm import shared, warc


def brute(rows):
    first, out = {}, []
    for i, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (h or "").encode()
        key = hashlib.sha256(body).hexdigest()
        if len(body) >= 100 and key in first:
            out.append((i, len(body), key, "revisit", first[key]))
        else:
            first.setdefault(key, i)
            out.append((i, len(body), key, "response", None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path, monkeypatch):
    shared.importable(spark)
    long = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 20
    rows = [(5, long), (3, long), (9, long), (3, long), (1, "short"), (2, "short"), (4, None), (6, ""), (7, "x" * 99), (8, "x" * 99), (10, "y\x00z\n" * 40), (None, long), (11, "z" * 200_000)]
    df = spark.createDataFrame([(i, f"http://h/{i}?a b#f\r\nx" if i != 7 else None, h, "w") for i, h in rows], "page_id long, url string, html string, digest string")
    warc.write_warc(df, str(tmp_path / "a"))
    records = warc.read_warc(spark, str(tmp_path / "a"))
    assert records.count() == 3 * len(rows) and records.select("record_id").distinct().count() == 3 * len(rows)
    got = warc.assemble(records).collect()
    assert len(got) == len(rows) and all(r["request"]["type"] == "request" and r["metadata"]["type"] == "metadata" for r in got)
    bodies = sorted(bytes(r["main"]["payload"]) for r in got if r["main"]["type"] == "response")
    want = brute(rows)
    by_digest = {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, h in rows}
    assert bodies == sorted(by_digest[w[2]] for w in want if w[3] == "response")
    (tmp_path / "sf").mkdir()
    df.write.parquet(str(tmp_path / "sf" / "pages.parquet"))
    assert sorted((tuple(r) for r in warc.op9(spark, str(tmp_path / "sf")).collect()), key=str) == want
    warc.write_warc(df.limit(0), str(tmp_path / "none"))
    assert warc.assemble(warc.read_warc(spark, str(tmp_path / "none"))).collect() == []


def test_foreign_archives(spark, tmp_path):
    def record(kind, rid, body=b"", **more):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{rid}>\r\n" + "".join(f"WARC-{k.replace('_', '-')}: {v}\r\n" for k, v in more.items())
        return head.encode() + f"Content-Type: application/http\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    # the main record names its request; the metadata names the main record; one side record belongs to nothing
    parts = [record("warcinfo", "i"), record("request", "q", b"GET /\r\n\r\n"), record("response", "r", b"HTTP/1.1 200\r\n\r\nbody\r\n\r\nmore", Concurrent_To="<q>"), record("metadata", "m", b"f: 1\r\n", Concurrent_To="<r>"), record("metadata", "lost", b"", Concurrent_To="<none>")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "CC-MAIN-0001.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    bad = record("response", "bad", b"HTTP/1.1 200\r\n\r\nlost").replace(b"Content-Length: 20", b"Content-Length: many")
    assert b"many" in bad
    (tmp_path / "d" / "second archive.warc").write_bytes(bad + parts[2].replace(b"<r>", b"<r2>").replace(b"Concurrent-To: <q>", b"X: y") + parts[1][:40])
    got = {r["record_id"]: r for r in warc.assemble(warc.read_warc(spark, str(tmp_path / "d"))).collect()}
    assert set(got) == {"r", "r2"} and bytes(got["r"]["main"]["payload"]) == b"body\r\n\r\nmore"
    assert got["r"]["request"]["record_id"] == "q" and got["r"]["metadata"]["record_id"] == "m" and got["r2"]["request"] is None
