"""Stupid-backoff language-model scores, computed relationally.

Every text becomes ids of a fixed public vocabulary once; the ids are kept in a table of chunks of whole texts.
A chunk's n-grams of the highest order are exploded with their counts (equal ones of a chunk first added up), counted
over all chunks into a table that is partitioned by a hash of the n-gram, and the tables of the lower orders are sums
of it. Joins of these tables, by hash as well, give each n-gram's logarithm of

    S_n = c(context w) / c(context)  if c(context w) >= least_count,  else  backoff * S_(n-1)
    S_1 = c(w) / N

The exploded n-grams are joined to that table, go back to their chunk, and are summed for each text.

The counts hold the scored text itself, so with ``least_count`` 1 no n-gram would ever back off; 2 takes an n-gram that
nothing but one place of the corpus has for unseen.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, text_chunks, written
from .tokens import WordTokens, default_tokenizer

#: Bits of an id inside an n-gram's key, and the id that stands before a text's first token.
BITS = 16
START = (1 << BITS) - 1
#: Text of a chunk; a chunk is what a scoring task holds at a time.
CHUNK_BYTES = 8 << 20
#: Text that is tokenized at a time.
SLICE_BYTES = 2 << 20
#: Tokens whose n-grams are looked up at a time.
SLICE = 1 << 19


def ngram_keys(ids: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the n-gram that ends at each token; START ids fill up before a text's first token."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    key = ids.astype(np.int64)
    place = np.arange(len(ids)) - offsets[text] if len(ids) else np.zeros(0, dtype=np.int64)
    for back in range(1, order):
        before = np.full(len(ids), START, dtype=np.int64)
        inside = np.flatnonzero(place >= back)
        before[inside] = ids[inside - back]
        key = key | (before << (BITS * back))
    return text, key


def pack_ids(ids: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(ids.astype("<u2").tobytes())


def unpack_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype="<u2").astype(np.int64)


def token_chunks(df: DataFrame, id_col: str, text_col: str, tokenizer: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, keys, lengths, tokens): whole texts of about ``chunk_bytes`` in a row, one text at least.

    chunk is unique; keys are the texts' ids, lengths their numbers of tokens, tokens the packed ids of all of them.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        words = WordTokens(tokenizer)
        name, keys, lengths, ids, size = None, [], [], [], 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([pa.concat_arrays(keys).to_pylist()], pa.list_(keys[0].type)), pa.array([np.concatenate(lengths).tolist()], pa.list_(pa.int64())), pa.array([pack_ids(np.concatenate(ids))], pa.binary())],
                names=["chunk", "keys", "lengths", "tokens"],
            )

        for batch in batches:
            for part in text_chunks(batch, "text", SLICE_BYTES):
                own, offsets = words.of_texts(part.column(2))
                name = part.column(0)[0].as_py() if name is None else name
                keys.append(part.column(1).take(pa.array(np.arange(part.num_rows))))  # a copy: a slice would keep the batch with its texts
                lengths.append(np.diff(offsets))
                ids.append(own.astype(np.uint16))
                size += part.column(2).nbytes
                if size >= chunk_bytes:
                    yield row()
                    name, keys, lengths, ids, size = None, [], [], [], 0
        if keys:
            yield row()

    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"chunk bigint, keys array<{kind}>, lengths array<bigint>, tokens binary")


def opened(chunk: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a chunk's texts and their offsets."""
    return unpack_ids(chunk["tokens"]), np.concatenate([[0], np.cumsum(np.array(chunk["lengths"], dtype=np.int64))])


def exploded(chunks: DataFrame, order: int) -> DataFrame:
    """(chunk, key, count): the distinct n-grams of each chunk."""

    def run(batches):
        for batch in batches:
            for chunk in batch.to_pylist():
                key, count = np.unique(ngram_keys(*opened(chunk), order)[1], return_counts=True)
                give_back()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), chunk["chunk"])), pa.array(key), pa.array(count)], names=["chunk", "key", "count"])

    return chunks.select("chunk", "lengths", "tokens").mapInArrow(run, "chunk bigint, key bigint, count bigint")


def _tail(key, order: int):
    """The key of the n-gram's last ``order`` tokens."""
    return key.bitwiseAND(F.lit((1 << (BITS * order)) - 1 if order < 4 else -1))


def log_scores(counts: DataFrame, order: int, backoff: float, least_count: int) -> DataFrame:
    """(key, s): log S of each n-gram of ``counts`` (key, count), which holds all n-grams of the highest order."""
    tables = {order: counts}
    for n in range(order - 1, 0, -1):
        tables[n] = written(tables[n + 1].groupBy(_tail(F.col("key"), n).alias("key")).agg(F.sum("count").alias("count")), f"order{n}")
    total = tables[1].agg(F.sum("count")).first()[0] or 1
    scores = tables[1].select("key", F.log(F.col("count") / F.lit(float(total))).alias("s"))
    for n in range(2, order + 1):
        context = F.shiftrightunsigned("key", BITS)
        before = tables[n].groupBy(context.alias("context")).agg(F.sum("count").alias("before"))
        own = written(tables[n].withColumn("context", context).join(before, "context").select("key", F.when(F.col("count") >= least_count, F.log(F.col("count") / F.col("before"))).alias("own")), "own")
        lower = scores.select(F.col("key").alias("tail"), F.col("s").alias("less"))
        scores = written(own.withColumn("tail", _tail(F.col("key"), n - 1)).join(lower, "tail").select("key", F.coalesce("own", F.col("less") + math.log(backoff)).alias("s")), f"scores{n}")
    return scores


def scored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, backoff: float = 0.4, least_count: int = 2, tokenizer: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id_col, n_tokens, mean_log_score, log_score) of each row of ``df`` under the n-grams of all its rows.

    A text without tokens (null, empty, blank) has 0 tokens, log_score 0 and a null mean. Repeated rows and rows that
    share an id count and are scored each; a null id is an id like any other. A text longer than ``chunk_bytes`` is a
    chunk by itself. Ties do not arise; other columns do not matter, whatever their names. An empty table gives an
    empty result. ``order`` is 2 to 4.
    """
    if not 2 <= order <= 4:
        raise ValueError("order must be 2, 3 or 4")
    kind = df.schema[id_col].dataType.simpleString()
    chunks = written(token_chunks(df, id_col, text_col, tokenizer or default_tokenizer(), chunk_bytes), "tokens")
    grams = exploded(chunks, order)
    counts = written(grams.groupBy("key").agg(F.sum("count").alias("count")), "ngrams")
    scores = log_scores(counts, order, backoff, least_count)
    known = written(grams.select("chunk", "key").join(scores.hint("merge"), "key").select("chunk", "key", "s"), "scored")

    def sums(own: pa.Table, grams: pa.Table) -> pa.Table:
        key = grams.column("key").to_numpy()
        turn = np.argsort(key)
        key, s = key[turn], grams.column("s").to_numpy()[turn]
        out = []
        for chunk in own.to_pylist():
            ids, offsets = opened(chunk)
            n, total = np.diff(offsets), np.zeros(len(offsets) - 1)
            cuts = np.unique(np.searchsorted(offsets, np.arange(0, offsets[-1] + SLICE, SLICE)).clip(0, len(n)))
            for i, j in zip(cuts[:-1], cuts[1:]):  # whole texts of about SLICE tokens, so that little is held besides the chunk
                text, at = ngram_keys(ids[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], order)
                total[i:j] = np.bincount(text, weights=s[np.searchsorted(key, at)], minlength=j - i)
            total = np.round(total, 6)
            mean = np.round(total / np.maximum(n, 1), 6)
            keys = pa.array(chunk["keys"], own.schema.field("keys").type.value_type)
            out.append(pa.table([keys, pa.array(n), pa.array(mean, mask=n == 0), pa.array(total)], names=["key", "n_tokens", "mean_log_score", "log_score"]))
        give_back()
        return pa.concat_tables(out) if out else pa.table([pa.array([], own.schema.field("keys").type.value_type), pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.float64())], names=["key", "n_tokens", "mean_log_score", "log_score"])

    found = chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(sums, f"key {kind}, n_tokens bigint, mean_log_score double, log_score double")
    return found.withColumnRenamed("key", id_col)
