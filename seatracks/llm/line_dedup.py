"""Lines that many documents share are kept in one document only.

The documents of each line are counted by a 128-bit hash of the line's key. The hashes of the lines in enough documents go
to shards of bounded size; each shard has a minimal perfect hash over its line hashes and, at the places that it gives,
arrays of fingerprints, counts and keepers (who holds the line last). Documents send the hashes of their lines to the
shards and probe the arrays; no lines are joined. A busy shard's arrays are sent to several tasks, so no task gets all
probes of a frequent line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import free_name, text_chunks, written

LEAST_CHARS = 40
LEAST_DOCS = 5
#: Distinct lines in a shard, on average: about 1.4 MB of arrays.
SHARD_LINES = 1 << 16
BLANK = " \t\n\x0b\x0c\r"


def _spread(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit value of each pair for each level."""
    x = a + np.uint64(level) * (b | np.uint64(1))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Gives n distinct pairs of 64-bit values the places 0 to n - 1; another pair gets any place or -1.

    A level is a bit array of twice the pairs left: pairs that meet no other there set their bit, the rest go on to
    the next level. The place is the number of bits set before.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def over(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while len(a):
            size = -(-2 * len(a) // 64) * 64
            at = _spread(a, b, len(sizes)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = ~alone[at.astype(np.int64)]
            a, b = a[left], b[left]
        return cls(np.array(sizes, dtype=np.int64), np.concatenate([np.zeros(0, np.uint64), *words]))

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, left, start = np.full(len(a), -1, dtype=np.int64), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = (_spread(a[left], b[left], level) % np.uint64(size)).astype(np.int64) + start
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = self.before[at[hit] >> 6] + below[hit]
            left, start = left[~hit], start + size
        return out


class Shard:
    """A perfect hash with the arrays that its places index."""

    COLUMNS = "sizes binary, words binary, prints binary, counts binary, keepers binary"

    def __init__(self, index: PerfectHash, prints: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.index, self.prints, self.counts, self.keepers = index, prints, counts, keepers

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> Shard:
        index = PerfectHash.over(a, b)
        order = np.argsort(index.places(a, b))
        return cls(index, b[order], counts[order], keepers[order])

    def pack(self) -> list[bytes]:
        return [x.tobytes() for x in (self.index.sizes, self.index.words, self.prints, self.counts, self.keepers)]

    @classmethod
    def unpack(cls, sizes: bytes, words: bytes, prints: bytes, counts: bytes, keepers: bytes) -> Shard:
        own = lambda x, kind: np.frombuffer(x, dtype=kind)
        return cls(PerfectHash(own(sizes, np.int64), own(words, np.uint64)), own(prints, np.uint64), own(counts, np.int64), own(keepers, np.int64))

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether the pair is listed, its count, its keeper) of each pair."""
        at = self.index.places(a, b)
        known = at >= 0
        known[known] = self.prints[at[known]] == b[known]
        at = np.where(known, at, 0)
        return known, np.where(known, self.counts[at], 0), self.keepers[at]


def key_hashes(texts: pa.Array, least_chars: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lines, offsets of the texts in them, numbers of the long lines, both halves of the hashes of their keys)."""
    import xxhash

    lists = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), "\n")
    lines = lists.flatten()
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
    keys = pc.ascii_lower(pc.ascii_trim(lines, BLANK))
    long = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), least_chars).to_numpy(zero_copy_only=False))
    coded = keys.take(pa.array(long)).dictionary_encode()
    digests = b"".join([xxhash.xxh3_128_digest(k) for k in coded.dictionary.cast(pa.large_binary()).to_pylist()])
    halves = np.frombuffer(digests, dtype=np.uint64).reshape(-1, 2)[coded.indices.to_numpy(zero_copy_only=False)]
    return lines, offsets, long, halves[:, 0], halves[:, 1]


def _of_rows(offsets: np.ndarray, long: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, a, b) of the distinct keys of each text."""
    row = np.searchsorted(offsets, long, side="right") - 1
    order = np.lexsort((b, a, row))
    row, a, b = row[order], a[order], b[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return row[new], a[new], b[new]


def line_counts(df: DataFrame, id_col: str, text_col: str, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(a, b, n, keeper): documents (rows) that hold the line, and the hash of the largest id among them."""

    def run(batches):
        for batch in batches:
            for part in text_chunks(batch, "text"):
                _, offsets, long, a, b = key_hashes(part.column(1), least_chars)
                row, a, b = _of_rows(offsets, long, a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), part.column(0).take(pa.array(row))], names=["a", "b", "id"])

    kind = df.schema[id_col].dataType.simpleString()
    pairs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"a bigint, b bigint, id {kind}")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("id").alias("last")).select("a", "b", "n", F.xxhash64("last").alias("keeper"))


def build_shards(counts: DataFrame, n_shards: int) -> DataFrame:
    """(shard, arrays) from (a, b, n, keeper); a shard's lines fit in a task by the choice of ``n_shards``."""

    def build(key, table):
        a, b, n, keeper = (table.column(c).to_numpy() for c in ("a", "b", "n", "keeper"))
        packed = Shard.of(a.view(np.uint64), b.view(np.uint64), n, keeper).pack()
        return pa.table({"shard": [key[0].as_py()]} | {c: [x] for c, x in zip(("sizes", "words", "prints", "counts", "keepers"), packed)}, schema=schema)

    schema = pa.schema([("shard", pa.int32()), *((c.split()[0], pa.binary()) for c in Shard.COLUMNS.split(", "))])
    sharded = counts.withColumn("shard", F.pmod("a", F.lit(n_shards)).cast("int"))
    return sharded.groupBy("shard").applyInArrow(build, f"shard int, {Shard.COLUMNS}")


def _probes(df: DataFrame, shares: list[int], least_chars: int) -> DataFrame:
    """(shard, share, a, b, r, s, who) of the distinct keys of each row; r, s: the row, who: its id, as hashes."""

    def run(batches):
        own = np.array(shares, dtype=np.int64)
        for batch in batches:
            for part in text_chunks(batch, "text"):
                _, offsets, long, a, b = key_hashes(part.column(0), least_chars)
                row, a, b = _of_rows(offsets, long, a, b)
                a, b = a.view(np.int64), b.view(np.int64)
                r, s, who = (part.column(i).to_numpy(zero_copy_only=False)[row] for i in (1, 2, 3))
                shard = np.mod(a, len(own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.astype(np.int32)), pa.array(np.mod(r, own[shard]).astype(np.int32)), *map(pa.array, (a, b, r, s, who))], names=["shard", "share", "a", "b", "r", "s", "who"]
                )

    return df.mapInArrow(run, "shard int, share int, a bigint, b bigint, r bigint, s bigint, who bigint")


def _answers(batches: Iterator[pa.RecordBatch], least_docs: int) -> Iterator[pa.RecordBatch]:
    """Probes come after the arrays of their shard; those of lines to drop are passed on."""
    shard, arrays = None, None
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        first = batch.column(1)
        cuts = np.flatnonzero(pc.is_valid(first).to_numpy(zero_copy_only=False) | np.concatenate([[True], numbers[1:] != numbers[:-1]])).tolist()
        for start, stop in zip(cuts, [*cuts[1:], batch.num_rows]):
            if first[start].is_valid:
                shard, arrays = numbers[start], Shard.unpack(*(batch.column(i)[start].as_py() for i in range(1, 6)))
                start += 1
            if start < stop and shard == numbers[start]:
                a, b, r, s, who = (batch.column(i).slice(start, stop - start).to_numpy() for i in range(6, 11))
                known, n, keeper = arrays.look_up(a.view(np.uint64), b.view(np.uint64))
                gone = known & (n >= least_docs) & (keeper != who)
                yield pa.RecordBatch.from_arrays([pa.array(x[gone]) for x in (a, b, r, s)], names=["a", "b", "r", "s"])


def lines_to_drop(keyed: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, shard_lines: int = SHARD_LINES) -> DataFrame:
    """(r, s, gone): key hashes of the lines that the row with the hashes r and s loses; from (id, text, r, s)."""
    spark = keyed.sparkSession
    seen = Observation()
    counts = line_counts(keyed, "id", "text", least_chars).observe(seen, F.sum("n").alias("probes"))
    often = written(counts.where(F.col("n") >= least_docs), "often")  # rarer lines lose nothing and are in no shard
    n_shards = max(1, -(-often.count() // shard_lines))
    shards = written(build_shards(often, n_shards), "shards")
    hot = {r["shard"]: r["n"] for r in often.groupBy(F.pmod("a", F.lit(n_shards)).cast("int").alias("shard")).agg(F.sum("n").alias("n")).collect()}  # one number for each shard
    total = seen.get["probes"] or 0
    task = max(1000, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    shares = [1 + (total // n_shards + hot.get(i, 0)) // task for i in range(n_shards)]
    sent = shards.withColumn("share", F.explode(F.sequence(F.lit(0), F.get(F.lit(shares).cast("array<int>"), F.col("shard")) - 1)))
    arrays = [c.split()[0] for c in Shard.COLUMNS.split(", ")]
    probes = _probes(keyed.select("text", "r", "s", F.xxhash64("id").alias("who")), shares, least_chars)
    both = sent.unionByName(probes, allowMissingColumns=True).repartition("shard", "share").sortWithinPartitions("shard", "share", F.col("words").isNull())
    both = both.select("shard", *arrays, "a", "b", "r", "s", "who")
    found = both.mapInArrow(lambda batches: _answers(batches, least_docs), "a bigint, b bigint, r bigint, s bigint")
    return found.groupBy("r", "s").agg(F.collect_set(F.struct("a", "b")).alias("gone"))


def deduplicated(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, names: tuple[str, str] = ("n_lines", "n_dropped"), shard_lines: int = SHARD_LINES
) -> DataFrame:
    """The rows of ``df`` without the lines that go, with the numbers of lines before and of dropped lines.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case; keys of at least ``least_chars``
    code points in at least ``least_docs`` documents go, except in the document with the largest id that holds them, which keeps
    all of its lines with the key. A null text is an empty one (one empty line) and comes back empty. Each row is a document
    of its own, also where rows share an id; of those that share the largest id all keep the line. Null ids are smaller than all others, and equal.
    Whole texts count, however long; an empty table gives an empty result; columns of ``df`` may have any names.
    """
    columns = df.columns
    r, s, gone = (free_name([*columns, *names], c) for c in ("_r", "_s", "_gone"))
    marks = {r: F.xxhash64(id_col, text_col), s: F.hash(text_col, id_col).cast("bigint")}
    keyed = df.withColumns(marks)
    drop = lines_to_drop(keyed.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(r).alias("r"), F.col(s).alias("s")), least_docs, least_chars, shard_lines)
    drop = written(drop, "drop").select(F.col("r").alias(r), F.col("s").alias(s), F.col("gone").alias(gone)).hint("merge")  # as a broadcast would shuffle no texts in a small table only
    joined = keyed.join(drop, [r, s], "left").select(*columns, gone)
    at = columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in text_chunks(batch, text_col):
                texts = pc.fill_null(part.column(at), "")
                n_lines = pc.add(pc.count_substring(texts, "\n"), 1).cast(pa.int64())
                dropped = np.zeros(part.num_rows, dtype=np.int64)
                cut = np.flatnonzero(pc.is_valid(part.column(len(columns))).to_numpy(zero_copy_only=False))
                if len(cut):
                    lines, offsets, long, a, b = key_hashes(texts.take(pa.array(cut)), least_chars)
                    row = np.searchsorted(offsets, long, side="right") - 1
                    out = texts.to_pylist()
                    sets = [{(x["a"], x["b"]) for x in part.column(len(columns))[i].as_py()} for i in cut.tolist()]
                    go = np.zeros(len(lines), dtype=bool)
                    go[long] = [pair in sets[k] for k, pair in zip(row.tolist(), zip(a.view(np.int64).tolist(), b.view(np.int64).tolist()))]
                    for k, i in enumerate(cut.tolist()):
                        own = go[offsets[k] : offsets[k + 1]]
                        dropped[i] = own.sum()
                        out[i] = "\n".join(lines.slice(offsets[k], len(own)).filter(pa.array(~own)).to_pylist())
                    texts = pa.array(out, part.column(at).type)
                arrays = [texts.cast(part.column(at).type) if i == at else part.column(i) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*arrays, n_lines, pa.array(dropped)], names=[*columns, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return joined.mapInArrow(run, f"{kinds}, `{names[0]}` bigint, `{names[1]}` bigint")
