import base64
import hashlib
import struct

import zstandard
from pyspark.sql import functions as F

from seatracks.llm import warc as A
from seatracks.llm.queries import queries

SCHEMA = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        f = first.get(h or "")
        revisit = len((h or "").encode()) >= least and f is not None and f != i
        out.append((i, len((h or "").encode()), digest(h), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


ROWS = [(3, "http://a/1", "<p>é</p>"), (1, "http://a/2", "<p>é</p>"), (2, None, None), (5, "u\r\nEvil: x", ""), (7, "http://b", "x" * 3_000_000), (8, "http://c", "a\r\n\r\nb"), (8, "http://c", "a\r\n\r\nb"), (None, "http://d", "<p>é</p>"), (None, "http://e", "alone")]


def test_round_trip_of_odd_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("key", F.lit("clash")).withColumn("size", F.lit(1))
    got = sorted(map(tuple, A.archived(df).collect()), key=str)
    assert got == expected(ROWS)
    got = sorted(map(tuple, A.archived(df, least_bytes=5).collect()), key=str)
    assert got == expected(ROWS, 5)
    assert A.archived(spark.createDataFrame([], SCHEMA)).count() == 0


def test_payloads_and_format(spark):
    rows = [(i, f"http://h/{i}", f"<html>page {i} " + "common words of all pages " * 40) for i in range(300)]
    folder, archives = A.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(2), "page_id", "html", "url")
    assert archives.agg(F.sum("records")).first()[0] == 300
    back = {int(r["key"]): (r["uri"], bytes(r["payload"])) for r in A.read_archives(spark, folder, with_payload=True).collect()}
    assert back == {i: (u, h.encode()) for i, u, h in rows}
    data = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).first()["content"]
    magic, size = struct.unpack_from("<II", data)
    assert 0x184D2A50 <= magic <= 0x184D2A5F
    words = zstandard.ZstdDecompressor().decompress(bytes(data[8 : 8 + size]), max_output_size=1 << 20)
    assert words[:4] == struct.pack("<I", 0xEC30A437)  # a trained dictionary
    first = next(iter(A.read_archive(bytes(data))))
    fields, block = A.parse_record(first)
    assert first.startswith(b"WARC/1.1\r\n") and first.endswith(b"\r\n\r\n") and int(fields["content-length"]) == len(block)
    assert fields["warc-type"] == "response" and {"warc-record-id", "warc-date", "warc-target-uri", "warc-payload-digest"} <= set(fields)


def test_archives_roll_over(spark, monkeypatch):
    monkeypatch.setattr(A, "ARCHIVE_BYTES", 5000)
    rows = [(i, f"http://h/{i}", f"page {i} " * 100) for i in range(50)]
    out = A.ArchiveWriter("file:///tmp/" + A.uuid.uuid4().hex, "part")
    for i, u, h in rows:
        out.add(A.record(str(i), u, h.encode(), len(h), digest(h), None))
    out.close()
    assert len(out.done) > 5 and sum(d[1] for d in out.done) == 50


def test_query_matches_brute_force(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, queries()["op4_warc"](spark, data).collect()), key=str) == expected(rows)


def test_any_text_or_bytes_may_be_an_id(spark):
    ids = ["a ", " a", "b\r\nX-Refers-To-Key: z", "%41", "é: ü", "", "x" * 10_000]
    rows = [(k, f"http://h/{i}", "same" if i % 2 else f"page {i}") for i, k in enumerate(ids)]
    got = {r["page_id"]: r["refers_to"] for r in A.archived(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    first = min(k for k, _, h in rows if h == "same")
    assert got == {k: (first if h == "same" and k != first else None) for k, _, h in rows}
    raw = [(bytearray([255, i, 10]), None, "same") for i in range(3)]
    got = {bytes(r["page_id"]): r["refers_to"] for r in A.archived(spark.createDataFrame(raw, "page_id binary, url string, html string")).collect()}
    assert {k: v and bytes(v) for k, v in got.items()} == {bytes([255, i, 10]): (bytes([255, 0, 10]) if i else None) for i in range(3)}


def test_names_of_shared_folders():
    assert A.arrow_uri("s3a://bucket/shared") == "s3://bucket/shared" and A.arrow_uri("file:///tmp/x") == "file:///tmp/x"


def test_payloads_are_read_in_batches(spark, monkeypatch):
    monkeypatch.setattr(A, "READ_BYTES", 2000)
    rows = [(i, None, f"page {i} " * 50) for i in range(40)]
    folder, _ = A.write_archives(spark.createDataFrame(rows, SCHEMA), "page_id", "html")
    back = {int(r["key"]): bytes(r["payload"]).decode() for r in A.read_archives(spark, folder, with_payload=True).collect()}
    assert back == {i: h for i, _, h in rows}


def test_record_ids_are_unique_and_revisits_name_a_record(spark):
    rows = [(1, None, "a"), (2, None, "a"), (3, None, "b"), (3, None, "b"), (4, None, "b"), (5, None, "c"), (5, None, "d"), (None, None, "e"), (None, None, "e"), (None, None, "f"), (6, None, "f"), (7, None, None)]
    for least in (0, 2):
        folder, _ = A.write_archives(spark.createDataFrame(rows * 2, SCHEMA).repartition(3), "page_id", "html", None, None, least)
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).collect()
        fields = [A.parse_record(raw)[0] for f in files for raw in A.read_archive(bytes(f["content"]))]
        ids = {f["warc-record-id"] for f in fields}
        assert len(fields) == len(ids) == 2 * len(rows)
        assert {f["warc-refers-to"] for f in fields if "warc-refers-to" in f} <= ids
    folder, _ = A.write_archives(spark.createDataFrame(rows[:2] + rows[9:11], SCHEMA), "page_id", "html")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).collect()
    fields = [A.parse_record(raw)[0] for f in files for raw in A.read_archive(bytes(f["content"]))]
    named = {f["warc-refers-to"]: f["x-refers-to-key"] for f in fields if f["warc-type"] == "revisit"}
    assert len(named) == 2 and named == {f["warc-record-id"]: f["x-row-key"] for f in fields if f["warc-type"] == "response"}
