"""WARC archives: captures written as request, response and metadata records, read back and assembled.

Writing and the search for equal payloads are DataFrame plans; a directory of archives is written by Spark's text writer
(a WARC record of a UTF-8 payload is itself UTF-8 text), each file one gzip member. The reader takes any archive, plain
or gzip, with one member or one a record, and cuts records by their Content-Length.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Smaller payloads are never revisits.
LEAST_REVISIT = 100
#: Copies of a row of the table of repeated payloads, so that a frequent payload is joined in that many tasks.
SALT = 16
_EOL = "\r\n"

RECORD = "record_id string, type string, concurrent_to array<string>, target_uri string, date string, refers_to string, payload_digest string, payload_length long, payload_sha256 string, http_header string, payload binary"


def _urn(kind: str, page: Column, digest: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("<urn:capture:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), F.substring(digest, 1, 16), F.lit(":"), ordinal.cast("string"), F.lit(f":{kind}>"))


def _record(block: Column, *headers: tuple[str, Column]) -> Column:
    """A record as text; a header whose value is null is left out."""
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_EOL)), F.lit("")) for name, value in headers]
    return F.concat(F.lit(f"WARC/1.1{_EOL}"), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_EOL * 2), block, F.lit(_EOL * 2))


def roles(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, digest, bytes, ordinal (of repeated rows), and `first`: the (page_id, digest, ordinal) it revisits, or null."""
    base = pages.select(pages[page_id].alias("page_id"), pages[url].cast("string").alias("url"), F.coalesce(pages[html].cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id"))
    many = base.groupBy("digest").agg(F.min(order).alias("least"), F.count("*").alias("n"), F.first("bytes").alias("size")).where(f"n > 1 AND size >= {LEAST_REVISIT}")
    many = many.select("digest", F.col("least.page_id").alias("first_id"), F.lit(True).alias("shared"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = base.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int")).join(many, ["digest", "salt"], "left")
    ordinal = F.row_number().over(Window.partitionBy("digest", "salt", "page_id").orderBy(F.col("url").asc_nulls_first())) - 1
    salted = salted.withColumn("ordinal", ordinal)
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("ordinal") == 0)
    return salted.withColumn("revisits", F.coalesce("shared", F.lit(False)) & ~is_first).drop("salt", "shared")


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes a capture per row: a request, a response or revisit with the html as payload, and a metadata record.

    Of rows with equal payloads of 100 bytes or more, the one with the least page_id (null last, ties by url) is a
    response, the others revisit it. A null html is an empty payload; a null url leaves out the target. Repeated rows are
    captures of their own. An empty table writes an archive without records. Other columns are ignored.
    """
    rows = roles(pages, page_id, url, html)
    target = F.regexp_replace(F.regexp_replace("url", r"[\r\n]+", ""), " ", "%20")
    own = lambda kind: _urn(kind, F.col("page_id"), F.col("digest"), F.col("ordinal"))
    main = F.when(F.col("revisits"), own("revisit")).otherwise(own("response"))
    header = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(_EOL * 2))
    common = (("WARC-Target-URI", target), ("WARC-Date", F.lit(date)))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    http = ("Content-Type", F.lit("application/http; msgtype=response"))
    host = F.coalesce(F.nullif(F.regexp_extract(target, r"^\w+://([^/]*)", 1), F.lit("")), F.lit("localhost"))
    place = F.coalesce(F.nullif(F.regexp_extract(target, r"^\w+://[^/]*(/[^#]*)", 1), F.lit("")), F.lit("/"))
    request = _record(F.concat(F.lit("GET "), place, F.lit(f" HTTP/1.1{_EOL}Host: "), host, F.lit(_EOL * 2)), ("WARC-Type", F.lit("request")), ("WARC-Record-ID", own("request")), ("WARC-Concurrent-To", main), *common, ("Content-Type", F.lit("application/http; msgtype=request")))
    response = _record(F.concat(header, F.col("html")), ("WARC-Type", F.lit("response")), ("WARC-Record-ID", main), *common, digest, http)
    revisit = _record(
        header, ("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", main), *common, digest, http,
        ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", _urn("response", F.col("first_id"), F.col("digest"), F.lit(0))),
    )
    facts = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(_EOL)), F.lit("")), F.coalesce(F.concat(F.lit("url: "), F.regexp_replace("url", r"[\r\n]+", " "), F.lit(_EOL)), F.lit("")))
    metadata = _record(facts, ("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", own("metadata")), ("WARC-Concurrent-To", main), *common, ("Content-Type", F.lit("application/warc-fields")))
    text = F.concat(request, F.when(F.col("revisits"), revisit).otherwise(response), metadata)
    # the writer ends each value with \n, the last byte of the metadata record
    lines = rows.select(F.regexp_replace(text, r"\n\z", "").alias("value"))
    lines.write.option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _stream(content: bytes):
    """Decompressed parts of an archive: plain, one gzip member, or many."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        part = zlib.decompressobj(31)
        data = content
        while True:
            out = part.decompress(data, 1 << 20)
            if out:
                yield out
            data = part.unconsumed_tail
            if part.eof or not data:
                break
        content = part.unused_data.lstrip(b"\0") if part.eof else b""


def parse(content: bytes):
    """(headers, block) of each record; headers are lists of values by lower-case name. A cut-off last record is left out."""
    buffer, source = bytearray(), _stream(content)

    def fill(n: int) -> bool:
        while len(buffer) < n:
            part = next(source, None)
            if part is None:
                return False
            buffer.extend(part)
        return True

    while True:
        while True:  # to the next record's version line
            if not fill(1):
                return
            if buffer[0] in b"\r\n":
                del buffer[0]
                continue
            break
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not fill(len(buffer) + 1):
                return
        if not buffer.startswith(b"WARC/"):  # behind a record of unknown length: on to the next version line
            at = buffer.find(b"\r\nWARC/", 0, end + 9)
            del buffer[: at + 2 if at >= 0 else end + 2]
            continue
        lines = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")
        headers: dict[str, list[str]] = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        length = headers.get("content-length", [""])[0]
        if not (length.isascii() and length.isdigit()):
            del buffer[: end + 4]
            continue
        size = int(length)
        if not fill(end + 4 + size):
            return
        block = bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 4 + size]
        yield headers, block


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def _row(headers: dict[str, list[str]], block: bytes, payloads: bool) -> dict:
    one = lambda name: headers.get(name, [None])[0]
    kind = one("warc-type")
    http, payload, size = None, block, len(block)
    if (one("content-type") or "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http, size = head.decode("latin-1"), len(payload)
        if kind == "revisit":  # the payload is elsewhere; the stored header has its length
            size = next((int(x.split(":")[1]) for x in http.split("\r\n") if x.lower().startswith("content-length:")), 0)
    return {
        "record_id": _bare(one("warc-record-id")), "type": kind, "concurrent_to": [_bare(x) for x in headers.get("warc-concurrent-to", [])],
        "target_uri": one("warc-target-uri"), "date": one("warc-date"), "refers_to": _bare(one("warc-refers-to")), "payload_digest": one("warc-payload-digest"),
        "payload_length": size, "payload_sha256": None if kind == "revisit" else hashlib.sha256(payload).hexdigest(),
        "http_header": http, "payload": payload if payloads or kind == "metadata" else None,
    }


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of a directory of archives, whatever the files' names; only names that start with `_` or `.` are not read.

    Without `payloads` those of requests and responses are only measured and digested. A record without a length, or with
    one that is no number, is left out and reading goes on at the next version line.
    """
    kinds = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}[k]) for n, k in (f.split(" ") for f in RECORD.split(", "))])

    def records(batches):
        for b in batches:
            for content in b["content"]:
                rows, size = [], 0
                for headers, block in parse(content.as_py()):
                    rows.append(_row(headers, block, payloads))
                    size += len(block)
                    if len(rows) >= 1024 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(records, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, and the structs `main` (response or revisit), `request` and `metadata`.

    Side records are joined through concurrent-to identifiers, whether they name the main record or it names them. Of
    several the least record id is taken; a main record without one has null there; side records of no capture are left
    out, as records without an id are.
    """
    fields = [f.name for f in records.schema]
    main = records.where("type IN ('response', 'revisit') AND record_id IS NOT NULL")
    side = records.where("type IN ('request', 'metadata') AND record_id IS NOT NULL")
    whole = F.struct(*fields)
    there = side.select(F.explode("concurrent_to").alias("capture"), "type", whole.alias("r"))
    named = main.select(F.explode("concurrent_to").alias("side_id"), F.col("record_id").alias("capture"))
    here = named.join(side.select(F.col("record_id").alias("side_id"), "type", whole.alias("r")), "side_id").select("capture", "type", "r")
    sides = there.unionByName(here).groupBy("capture").agg(*[F.min_by(F.when(F.col("type") == k, F.col("r")), F.when(F.col("type") == k, F.col("r.record_id"))).alias(k) for k in ("request", "metadata")])
    return main.select(F.col("record_id").alias("capture"), whole.alias("main")).join(sides, "capture", "left").withColumnRenamed("capture", "record_id")


def op9(spark, sf_dir: str) -> DataFrame:
    """Contract query: the pages written as archives, read back and assembled."""
    path = f"{shared.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    rows = assemble(read_warc(spark, path, payloads=False))
    page = F.regexp_extract(F.col("metadata.payload").cast("string"), r"(?:^|\n)page-id: (-?\d+)\r", 1)
    first = F.regexp_extract("main.refers_to", r"^urn:capture:(-?\d+):", 1)
    return rows.select(
        F.nullif(page, F.lit("")).cast("long").alias("page_id"), F.col("main.payload_length").alias("payload_bytes"),
        F.coalesce(F.col("main.payload_sha256"), F.substring_index("main.payload_digest", ":", -1)).alias("payload_digest"),
        F.col("main.type").alias("record_type"), F.when(F.col("main.type") == "revisit", F.nullif(first, F.lit("")).cast("long")).alias("refers_to"),
    )


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN f ON d.payload_digest = f.payload_digest
"""
