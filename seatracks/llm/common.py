"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word pattern of the query contracts: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may do without the setting; it then gets a temporary folder once.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage at a table that outlives executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, key: str, name: str = "step") -> DataFrame:
    """Like ``written``, in buckets of ``key``: joins on it need no shuffle of the table."""
    spark = df.sparkSession
    entry = f"{name}_{uuid.uuid4().hex}"
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)  # Spark's limit
    df.write.format("parquet").bucketBy(buckets, key).option("path", new_folder(spark, name)).saveAsTable(entry)
    table = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")  # the entry alone: files at a given path stay
    return table


def free_name(taken, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``taken`` has (case does not count)."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def text_chunks(batch: pa.RecordBatch, text_col: str, max_bytes: int = 4 << 20):
    """Split an Arrow batch into slices of about ``max_bytes`` of text, at least one row each.

    What a slice took is given back before the next one, so a worker needs memory for one slice.
    """
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    start, n = 0, batch.num_rows
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
        give_back()


def split_words(texts: pa.Array, sep_regex: str | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of each text as codes into the array of distinct words.

    Returns (codes of all words in order, distinct words, offsets of the texts in codes). Without
    ``sep_regex`` words are split at ASCII white space. Null texts have no words; empty words never count.
    """
    texts = pc.fill_null(texts, "")
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    if sep_regex:
        texts = pc.replace_substring_regex(texts, sep_regex, " ")
        lists = pc.split_pattern(texts, " ")
    else:
        lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
    coded = flat.dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    empty = pc.index(words, pa.scalar("", type=words.type)).as_py()
    if empty >= 0:
        keep = codes != empty
        kept = np.concatenate([[0], np.cumsum(keep)])
        codes, offsets = codes[keep], kept[offsets]
    return codes, words, offsets


def sum_by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum ``values`` (one row per word) over each text's words."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def window_hash(chars: np.ndarray, before: np.ndarray | None, width: int) -> np.ndarray:
    """Rolling hash of all windows of ``width`` code points (rows: words), from those one narrower."""
    c = chars[:, width - 1 :].astype(np.uint64) + np.uint64(1)
    if before is None:
        return c * np.uint64(0x9E3779B97F4A7C15)
    return (before[:, : c.shape[1]] + c) * np.uint64(0x9E3779B97F4A7C15)


class StringTable:
    """Looks up all short substrings of many words at once in a fixed list of strings.

    Candidates are found by a rolling 64-bit hash; the hashes of the listed strings are checked to
    be distinct, so a listed string always gets its own id.
    """

    def __init__(self, strings: list[str]):
        self.width = max(map(len, strings), default=0)
        self.keys: dict[int, np.ndarray] = {}
        self.ids: dict[int, np.ndarray] = {}
        self.seen: dict[int, np.ndarray] = {}
        by_len: dict[int, list[int]] = {}
        for i, s in enumerate(strings):
            by_len.setdefault(len(s), []).append(i)
        for n, own in by_len.items():
            chars = np.array([strings[i] for i in own], dtype=f"U{n}").view(np.uint32).reshape(-1, n)
            h = None
            for k in range(1, n + 1):
                h = window_hash(chars, h, k)
            h = h[:, 0]
            order = np.argsort(h)
            self.keys[n], self.ids[n] = h[order], np.array(own, dtype=np.int64)[order]
            if len(np.unique(h)) != len(h):
                raise ValueError("two listed strings share a hash")
            seen = np.zeros(1 << 18, dtype=bool)
            seen[(h >> np.uint64(46)).astype(np.int64)] = True
            self.seen[n] = seen

    def matches(self, chars: np.ndarray):
        """Yields (width, id of each window or -1) for each width that the words are long enough for."""
        h = None
        for n in range(1, min(self.width, chars.shape[1]) + 1):
            h = window_hash(chars, h, n)
            out = np.full(h.shape, -1, dtype=np.int64)
            if n in self.keys:
                flat, res = h.ravel(), out.ravel()
                hit = np.flatnonzero(self.seen[n][(flat >> np.uint64(46)).astype(np.int64)])
                at = np.searchsorted(self.keys[n], flat[hit])
                at[at == len(self.keys[n])] = 0
                ok = self.keys[n][at] == flat[hit]
                res[hit[ok]] = self.ids[n][at[ok]]
                out = res.reshape(h.shape)
            yield n, out


def by_length(words: list[str]):
    """Yields (positions, matrix of code points) for the words of each length."""
    if not words:
        return
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for own in np.split(order, cuts):
        n = int(lengths[own[0]])
        if n:
            yield own, np.array([words[i] for i in own], dtype=f"U{n}").view(np.uint32).reshape(-1, n)
