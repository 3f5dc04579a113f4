"""Quality rules: statistics of each text, and cross-document line frequency within a host.

Lines are normalised (lower case, 0-9 to 0, white space squeezed) and hashed. For each host and line, the different
documents that hold it are counted, told apart by a hash of the raw text: exact copies count once, texts that differ in
as little as a number count each. A line that more than ``most_docs`` documents of its host hold, however large the host
is, is boilerplate and removed; a document that keeps too little of its words is depleted and rejected.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, split_words, text_chunks, written

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
DIGITS = re.compile(r"[0-9]")
#: A line may stand in so many different documents of a host; share of its words that a document must keep.
MOST_DOCS = 10
MIN_LEFT = 0.3
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def line_hash(line: str) -> int | None:
    """Signed 64-bit hash of a normalised line; None if it has no word."""
    words = DIGITS.sub("0", line.lower()).encode("utf-8", "surrogatepass").split()
    if not words:
        return None
    h = xxhash.xxh64_intdigest(b" ".join(words))
    return h - (1 << 64) if h >> 63 else h


def repeated_words(codes: np.ndarray, offsets: np.ndarray, n_distinct: int) -> np.ndarray:
    """For each text, its words inside 3-word windows that the text has twice or more."""
    n = len(codes)
    out = np.zeros(n, dtype=np.int64)
    if n >= 3:
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        at = np.flatnonzero(doc[2:] == doc[:-2])
        c = codes.astype(np.int64)
        if n_distinct < 2_000_000:
            key = (c[at] * n_distinct + c[at + 1]) * n_distinct + c[at + 2]
        else:
            pair = np.unique(c[:-1] * n_distinct + c[1:], return_inverse=True)[1]
            key = pair[at] * n_distinct + c[at + 2]
        order = np.argsort(key, kind="stable")  # within a key the texts stay in order
        k, d = key[order], doc[at][order]
        same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
        twice = np.zeros(len(at), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        for shift in range(3):
            out[hit + shift] = 1
    total = np.concatenate([[0], np.cumsum(out)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _lines(text: str) -> tuple[int, list[int], list[int]]:
    """(repeated lines, hashes of the distinct normalised lines, words under each)."""
    seen: set[str] = set()
    words: dict[int, int] = {}
    again = 0
    for line in text.split("\n"):
        h = line_hash(line)
        if h is None:
            continue
        if line in seen:
            again += 1
        seen.add(line)
        words[h] = words.get(h, 0) + len(line.encode("utf-8", "surrogatepass").split())
    return again, list(words), list(words.values())


def text_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id_col, host, the five statistics, body (hash of the raw text) and lines (hash, words) of each row."""

    def run(batches):
        for batch in batches:
            for part in text_chunks(batch, "text"):
                texts = pc.fill_null(part.column(3), "")
                codes, words, offsets = split_words(texts)
                plain = texts.to_pylist()
                raw = [t.encode("utf-8", "surrogatepass") for t in plain]
                white = np.array([len(b) - len(b.translate(None, WHITE)) for b in raw], dtype=np.int64)
                symbols = np.array([len(b) - len(b.translate(None, SYMBOLS)) for b in raw], dtype=np.int64)
                lines = [_lines(t) for t in plain]
                cuts = np.concatenate([[0], np.cumsum([len(x[1]) for x in lines])]).astype(np.int32)
                pairs = pa.StructArray.from_arrays(
                    [pa.array([h for x in lines for h in x[1]], pa.int64()), pa.array([w for x in lines for w in x[2]], pa.int64())], names=["h", "w"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(np.diff(offsets)),
                        pa.array(np.fromiter(map(len, plain), dtype=np.int64, count=len(plain)) - white),
                        pa.array(symbols),
                        pa.array([x[0] for x in lines], pa.int64()),
                        pa.array(repeated_words(codes, offsets, len(words))),
                        part.column(2),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs),
                    ],
                    names=[id_col, "host", *STATS, "body", "lines"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    stats = ", ".join(f"{c} bigint" for c in STATS)
    return df.select(F.col(id_col), F.col(host_col).cast("string").alias("host"), F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, host string, {stats}, body bigint, lines array<struct<h:bigint,w:bigint>>"
    )


def base_failed(min_words: int = 50, max_repeat_percent: int = 50):
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def frequent_lines(stats: DataFrame, most_docs: int = MOST_DOCS) -> DataFrame:
    """(host, h) of the lines that more than ``most_docs`` different documents of their host hold."""
    pairs = stats.select(F.coalesce("host", F.lit("")).alias("host"), "body", F.explode("lines.h").alias("h"))
    counts = pairs.groupBy("host", "h", "body").agg(F.lit(1).alias("one")).groupBy("host", "h").agg(F.count("*").alias("docs"))
    return counts.where(F.col("docs") > most_docs).select("host", "h")


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most_docs: int = MOST_DOCS, min_left: float = MIN_LEFT) -> tuple[DataFrame, DataFrame]:
    """(verdicts, removed): the statistics of each row with base_failed, words_removed and kept; and (id_col, hashes) of the lines to remove.

    Null and empty texts have no words and fail the base rule; a null host is a host of its own (with
    the empty name); whole texts count, however long; repeated rows are judged alike; a line in exactly ``most_docs``
    documents stays; other columns do not matter; an empty table gives empty results.
    """
    stats = written(text_statistics(df, id_col, text_col, host_col).withColumn("rid", F.monotonically_increasing_id()), "stats")
    often = written(frequent_lines(stats, most_docs), "frequent")
    lines = stats.select("rid", id_col, F.coalesce("host", F.lit("")).alias("host"), F.explode("lines").alias("line")).select("rid", id_col, "host", F.col("line.h").alias("h"), F.col("line.w").alias("w"))
    gone = written(lines.join(often, ["host", "h"]).groupBy("rid").agg(F.sum("w").alias("words_removed"), F.first(id_col).alias(id_col), F.collect_set("h").alias("hashes")), "gone")
    verdicts = stats.drop("lines", "body").join(gone.select("rid", "words_removed"), "rid", "left").fillna(0, ["words_removed"])
    verdicts = verdicts.withColumn("base_failed", base_failed())
    left = F.col("n_words") - F.col("words_removed")
    return verdicts.withColumn("kept", ~F.col("base_failed") & (left >= min_left * F.col("n_words"))).drop("rid"), gone.select(id_col, "hashes")


def cleaned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The rows of ``df`` that are kept, their boilerplate lines removed.

    A verdict follows from text and host, so rows are told apart by these and the id: rows may share an id or have
    none. Otherwise as ``judged``; columns of ``df`` may have any names.
    """
    columns = df.columns
    key, host, body, cut = (free_name(columns, c) for c in ("_key", "_host", "_body", "_cut"))
    row = F.struct(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.xxhash64(text_col).alias("body"))
    verdicts, removed = judged(df.select(row.alias("row"), F.col(text_col).alias("text"), F.col(host_col).alias("source")), "row", "text", "source", **limits)
    fields = [F.col("row.id").alias(key), F.col("row.host").alias(host), F.col("row.body").alias(body)]
    cuts = removed.groupBy("row").agg(F.max(F.array_sort("hashes")).alias(cut))  # equal rows have equal lists
    plan = verdicts.where("kept").select("row").distinct().join(cuts, "row", "left").select(*fields, cut)
    keyed = df.withColumns({host: F.coalesce(F.col(host_col).cast("string"), F.lit("")), body: F.xxhash64(text_col)})
    plan = written(plan, "plan").hint("merge")  # as a broadcast would shuffle no texts in a small table only
    joined = keyed.join(plan, keyed[id_col].eqNullSafe(plan[key]) & (keyed[host] == plan[host]) & (keyed[body] == plan[body]))
    joined = joined.select(*(keyed[c] for c in columns), plan[cut])
    at = columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in text_chunks(batch, text_col):
                cuts = part.column(len(columns)).to_pylist()
                texts = part.column(at).to_pylist()
                for i, own in enumerate(cuts):
                    if own and texts[i]:
                        drop = set(own)
                        texts[i] = "\n".join(x for x in texts[i].split("\n") if line_hash(x) not in drop)
                arrays = [pa.array(texts, part.column(at).type) if i == at else part.column(i) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return joined.mapInArrow(run, df.schema)
