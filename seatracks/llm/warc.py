"""WARC archives with per-record Zstandard frames and an embedded dictionary.

A file starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself a Zstandard
frame; each record follows as a frame of its own, compressed whole with the dictionary. The dictionary is trained on
a bounded sample of the file's own records (``sample_bytes`` of its first ones, ``record_sample`` of each). Payloads
that an earlier id already has are written as revisit records without payload.

Executors write through pyarrow's file systems under a hidden name and rename when a file is complete;
names and contents depend on the rows alone, so a task that runs again replaces its own files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import new_folder, written

DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_BYTES = 64 << 10
#: What the dictionary is trained on: so much of the first records of an archive, and so much of each.
SAMPLE_BYTES = 4 << 20
RECORD_SAMPLE = 128 << 10
#: Uncompressed size from which on an archive is closed; payloads that are read again are passed on in batches of about READ_BYTES.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 16 << 20
LEVEL = 3
CAPTURED = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(key: str | None, digest: str, place: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{place}:{digest}:{key}')}>"


def record(key: str | None, uri: str | None, payload: bytes | None, size: int, digest: str, refers_to: str | None, place: str | None = None, by_id: bool = True) -> bytes:
    """One record: a response with its payload, or a revisit of ``refers_to`` with the HTTP header only.

    The record's id is made of key and digest; where these do not tell records apart, of its ``place`` in the archives
    too. A revisit names its response's record id ``by_id``, unless several records could be meant.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(key, digest, place)}", f"WARC-Date: {CAPTURED}", "Content-Type: application/http;msgtype=response"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {' '.join(uri.split())}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if key is not None:
        head.append(f"X-Row-Key: {quote(key, safe='')}")  # any text fits into the line
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Key: {quote(refers_to, safe='')}"]
        if by_id:
            head.append(f"WARC-Refers-To: {_record_id(refers_to, digest, None)}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:]))
    return fields, rest[: int(fields["content-length"])]


def build_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary; where there is too little to train on, the plain start of the samples."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def arrow_uri(folder: str) -> str:
    """The folder as pyarrow's file systems name it: Spark's names of S3 are s3a and s3n."""
    scheme, mark, rest = folder.partition("://")
    return f"s3://{rest}" if mark and scheme in ("s3a", "s3n") else folder


class ArchiveWriter:
    def __init__(self, folder: str, stem: str, sample_bytes: int | None = None, record_sample: int | None = None):
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(arrow_uri(folder))
        self.sample_bytes, self.record_sample = sample_bytes or SAMPLE_BYTES, record_sample or RECORD_SAMPLE
        self.stem, self.n, self.done = stem, 0, []
        self._clear()

    def _clear(self):
        self.waiting, self.waiting_bytes, self.raw, self.records, self.out, self.packer = [], 0, 0, 0, None, None

    def add(self, raw: bytes) -> None:
        self.raw += len(raw)
        self.records += 1
        if self.out is None:
            self.waiting.append(raw)
            self.waiting_bytes += len(raw)
            if self.waiting_bytes >= self.sample_bytes:
                self._open()
        else:
            self.out.write(self.packer.compress(raw))
        if self.raw >= ARCHIVE_BYTES:
            self.close()

    def _open(self) -> None:
        self.fs.create_dir(self.folder, recursive=True)
        self.temp = f"{self.folder}/_writing-{uuid.uuid4().hex}"
        samples, room = [], self.sample_bytes
        for raw in self.waiting:
            if room <= 0:
                break
            samples.append(raw[: self.record_sample])
            room -= len(samples[-1])
        words = build_dictionary(samples)
        frame = zstandard.ZstdCompressor(level=LEVEL).compress(words.as_bytes())
        self.out = self.fs.open_output_stream(self.temp)
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(frame)) + frame)
        words.precompute_compress(level=LEVEL)
        self.packer = zstandard.ZstdCompressor(dict_data=words, write_checksum=True)
        for raw in self.waiting:
            self.out.write(self.packer.compress(raw))
        self.waiting = []

    def close(self) -> None:
        if self.records:
            if self.out is None:
                self._open()
            self.out.close()
            name = f"{self.stem}-{self.n:04d}.warc.zst"
            self.fs.move(self.temp, f"{self.folder}/{name}")
            self.done.append((name, self.records, self.raw))
            self.n += 1
        self._clear()


def read_archive(data: bytes):
    """Yields the raw records of one archive."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive has no leading dictionary frame")
    words = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size], max_output_size=1 << 30)
    trained = words[:4] == struct.pack("<I", 0xEC30A437)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT))
    at, view, step = 8 + size, memoryview(data), 32 << 10
    while at < len(data):
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            chunk = view[at : at + step]
            if not len(chunk):
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(chunk))
            at += len(chunk)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def write_archives(df: DataFrame, id_col: str, text_col: str, uri_col: str | None = None, folder: str | None = None, least_bytes: int = 0, sample_bytes: int | None = None, record_sample: int | None = None) -> tuple[str, DataFrame]:
    """Write a record for each row; returns the folder and (file, records, raw_bytes) of the archives.

    Of rows with equal payloads of at least ``least_bytes`` bytes, that with the smallest id is the
    response (so are rows that repeat its id) and the others revisit it; rows with a null id are
    responses unless another row with the payload has an id. Record ids are unique, whatever rows repeat. A null text is an empty payload; texts are archived whole,
    however long; ids may be any text or bytes; other columns do not matter. An empty table gives no archive.
    """
    binary = isinstance(df.schema[id_col].dataType, BinaryType)
    as_key = (lambda c: F.hex(c)) if binary else (lambda c: F.col(c).cast("string"))

    folder = folder or new_folder(df.sparkSession, "warc")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("id"), (F.col(uri_col).cast("string") if uri_col else F.lit(None).cast("string")).alias("uri"), text.alias("text"), F.sha1(text.cast("binary")).alias("sha1"), F.octet_length(text).cast("bigint").alias("size")
    )
    ids = rows.where(F.col("size") >= least_bytes).groupBy("sha1", "id").agg(F.count("*").alias("n"))
    first = ids.groupBy("sha1").agg(F.min("id").alias("first"), F.sum("n").alias("n"), F.min_by("n", F.struct(F.col("id").isNull(), "id")).alias("alike"))
    first = written(first.where("n > 1").select("sha1", "first", F.col("alike").alias("n_first")), "first")
    known = rows.join(first, "sha1", "left")
    refers = F.when((F.col("size") >= least_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    alone = F.col("n_first").isNull() & (F.col("size") >= least_bytes)  # no other row has the payload
    sole = F.coalesce(F.col("id") == F.col("first"), F.lit(False)) & (F.col("n_first") == 1)  # the response that others revisit
    known = known.withColumns({"refers": refers, "named": F.coalesce(alone | sole, F.lit(False)), "by_id": F.coalesce(F.col("n_first") == 1, F.lit(True))})
    slim = known.select(as_key("id").alias("key"), "uri", F.when(F.col("refers").isNull(), F.col("text")).alias("text"), "size", "sha1", as_key("refers").alias("refers"), "named", "by_id", "id")

    def write(batches):
        stem, n = f"part-{TaskContext.get().partitionId():06d}", 0
        out = ArchiveWriter(folder, stem, sample_bytes, record_sample)
        for batch in batches:
            key, uri, text, size, sha1, refers, named, by_id = (batch.column(i).to_pylist() for i in range(8))
            for i in range(batch.num_rows):
                digest, n = base64.b32encode(bytes.fromhex(sha1[i])).decode(), n + 1
                payload = None if text[i] is None else text[i].encode("utf-8", "surrogatepass")
                out.add(record(key[i], uri[i], payload, size[i], digest, refers[i], None if named[i] else f"{stem}/{n}", by_id[i]))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in out.done], pa.string()), pa.array([d[1] for d in out.done], pa.int64()), pa.array([d[2] for d in out.done], pa.int64())], names=["file", "records", "raw_bytes"])

    ordered = slim.sortWithinPartitions("id", "uri", "sha1").drop("id")
    return folder, written(ordered.mapInArrow(write, "file string, records bigint, raw_bytes bigint"), "archives")


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """(key, uri, record_type, payload_bytes, payload_digest, refers_to[, payload]) of all records under ``folder``.

    A response's digest is computed from its payload and must be the one in its header. Keys are the ids as text, those
    that are bytes in hexadecimal digits.
    """
    names = ["key", "uri", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * with_payload

    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    text_of = lambda x: None if x is None else unquote(x)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    def read(batches):
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for raw in read_archive(data.as_buffer().to_pybytes() if hasattr(data, "as_buffer") else data.as_py()):
                    fields, block = parse_record(raw)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    if kind == "response" and (payload_digest(payload) != digest or len(payload) != size):
                        raise ValueError(f"damaged payload: {fields['warc-record-id']}")
                    rows.append((text_of(fields.get("x-row-key")), fields.get("warc-target-uri"), kind, size, digest, text_of(fields.get("x-refers-to-key")), *([payload] * with_payload)))
                    held += 512 + len(payload) * with_payload
                    if held >= READ_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    schema = "key string, uri string, record_type string, payload_bytes bigint, payload_digest string, refers_to string" + ", payload binary" * with_payload
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("content").mapInArrow(read, schema)


def archived(df: DataFrame, id_col: str = "page_id", text_col: str = "html", uri_col: str | None = "url", least_bytes: int = 0) -> DataFrame:
    """Write archives of ``df`` and read them back: (id_col, payload_bytes, payload_digest, record_type, refers_to).

    Odd rows as in ``write_archives``; repeated rows have a record each; an empty table gives an empty result.
    """
    spark = df.sparkSession
    folder, archives = write_archives(df, id_col, text_col, uri_col, None, least_bytes)
    kind = df.schema[id_col].dataType
    if archives.isEmpty():
        return spark.createDataFrame([], f"`{id_col}` {kind.simpleString()}, payload_bytes bigint, payload_digest string, record_type string, refers_to {kind.simpleString()}")
    back = read_archives(spark, folder)
    as_id = F.unhex if isinstance(kind, BinaryType) else lambda c: F.col(c).cast(kind)
    return back.select(as_id("key").alias(id_col), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to"))
