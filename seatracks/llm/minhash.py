"""Texts that share most of their word shingles: MinHash bands and prefixes give candidates, whole texts decide.

Words are lower-cased in A-Z and split at ASCII white space; a text of fewer words than a shingle has one shingle, a text
without words none. Each text gets ``BANDS`` keys of ``ROWS`` minima: two texts of similarity s share a key with
probability 1 - (1 - s^6)^12, which is 0.97 at 0.8 and 0.999 at 0.87.

Prefixes lose nothing: with all shingles in one order, whatever it is, two texts of similarity s share one of the first
n - ceil(s n) + 1 of their n shingles each, and the first one they share leaves enough of both behind it. Parity sketches
lose nothing either: each shingle flips one bit, so two sketches differ in at most as many bits as the texts in shingles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_chunks

BANDS, ROWS = 12, 6
SEED = 42
#: Bits of the filter of frequent shingles, by their upper bits. Its false positives only change the order of shingles.
COMMON_BITS = 22
#: Against rounding: bounds of candidates are this much wider.
SLACK = 1e-9
#: Texts of a key that meet each other in one task.
BLOCK = 512


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct shingles' 64-bit hashes in order."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        h = _mixed(h ^ each[i : i + n]) + np.uint64(i)
    return np.unique(h)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band; none without shingles."""
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64)
    rng = np.random.default_rng(SEED)
    salts = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
    least = np.array([_mixed(hashes ^ s).min() for s in salts], dtype=np.uint64).reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in range(ROWS):
        keys = _mixed(keys ^ least[:, row]) + np.uint64(row)
    return keys


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """A power of two of bits, 64 or more and at least one a shingle, as 64-bit words."""
    bits = 1 << max(6, (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def sketches_differ(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two sketches differ, the longer one folded to the length of the other: a lower bound of the
    shingles that only one text has."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())  # of signed numbers it would count the absolute value


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray | None = None) -> np.ndarray:
    """The shingles one of which each text of that similarity shares, in their order: those outside the filter ``common``
    first, then by hash."""
    n = len(hashes)
    if not n:
        return hashes
    if common is not None:
        at = hashes >> np.uint64(64 - COMMON_BITS)
        late = (common[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
        hashes = hashes[np.argsort(late, kind="stable")]
    return hashes[: n - math.ceil(similarity * n - SLACK) + 1]


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0, dtype=np.int64)])))


def profiled(texts: DataFrame, similarity: float, width: int = 5) -> DataFrame:
    """(sid, size, bands, prefix, sketch) for each row of ``texts`` (sid long, text string)."""

    def run(batches):
        for batch in batches:
            for part in text_chunks(batch, "text"):
                hashes = [shingle_hashes(t, width) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(h) for h in hashes], type=pa.int32()),
                        _lists([band_keys(h).view(np.int64) for h in hashes]),
                        _lists([prefix(h, similarity).view(np.int64) for h in hashes]),
                        _lists([parity_sketch(h) for h in hashes]),
                    ],
                    names=["sid", "size", "bands", "prefix", "sketch"],
                )

    kinds = "sid bigint, size int, bands array<bigint>, prefix array<bigint>, sketch array<bigint>"
    return texts.select("sid", "text").mapInArrow(run, kinds)


def prefixed(texts: DataFrame, similarity: float, width: int, common: np.ndarray) -> DataFrame:
    """(sid, size, prefix) for each row of ``texts``, shingles in the filter ``common`` last."""

    def run(batches):
        for batch in batches:
            for part in text_chunks(batch, "text"):
                hashes = [shingle_hashes(t, width) for t in part.column(1).to_pylist()]
                sizes = pa.array([len(h) for h in hashes], type=pa.int32())
                prefixes = _lists([prefix(h, similarity, common).view(np.int64) for h in hashes])
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, prefixes], names=["sid", "size", "prefix"])

    return texts.select("sid", "text").mapInArrow(run, "sid bigint, size int, prefix array<bigint>")


def shared_postings(rooted: DataFrame) -> DataFrame:
    """(key, n, sid, size, root, at): the places of ``rooted`` (sid, size, root, prefix) at prefix shingles that texts of
    more than one root have; n texts have that shingle."""
    places = rooted.select("sid", "size", "root", F.posexplode("prefix").alias("at", "key"))
    key = Window.partitionBy("key")  # one exchange of the places: a grouping and a join would need two
    seen = places.select("*", F.count("*").over(key).alias("n"), F.min("root").over(key).alias("low"), F.max("root").over(key).alias("high"))
    return seen.where("low < high").drop("low", "high")


def prefix_pairs(shared: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a < b) of different roots that may have the similarity by the first shingle they share.

    The texts of a frequent shingle meet each other in blocks, so in many tasks.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    left = shared.select("key", F.pmod(F.xxhash64("sid"), blocks).cast("int").alias("block"), *(F.col(c).alias(f"{c}_a") for c in ("sid", "size", "root", "at")))
    right = shared.select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), *(F.col(c).alias(f"{c}_b") for c in ("sid", "size", "root", "at")))
    behind = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    enough = similarity / (1 + similarity) * (F.col("size_a") + F.col("size_b")) - SLACK
    fits = (F.col("sid_a") < F.col("sid_b")) & (F.col("root_a") != F.col("root_b")) & (behind >= enough)
    met = left.join(right, (left["key"] == right["key"]) & (left["block"] == right["block"]) & fits)
    return met.select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b")).distinct()


def common_shingles(keys: DataFrame) -> np.ndarray:
    """The filter of ``keys`` (key): 2 ** ``COMMON_BITS`` bits as 64-bit words, however many keys there are."""
    at = F.shiftrightunsigned("key", 64 - COMMON_BITS)
    words = keys.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(key, %d) & 63 as int))" % (64 - COMMON_BITS))).alias("bits"))
    out = np.zeros(1 << (COMMON_BITS - 6), dtype=np.int64)
    for word, bits in words.collect():
        out[word] = bits
    return out.view(np.uint64)


def may_be_similar(pairs: DataFrame, profiles: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) that sizes and parity sketches do not rule out; ``profiles``: (sid, size, sketch)."""

    def run(batches):
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size_a", "size_b"))
            most = (n_a + n_b) * (1 - similarity) / (1 + similarity) + SLACK
            keep = np.abs(n_a - n_b) <= most
            words, ends = [], []
            for c in ("sketch_a", "sketch_b"):
                words.append(batch.column(c).flatten().to_numpy(zero_copy_only=False))
                ends.append(np.cumsum([0, *batch.column(c).value_lengths().to_pylist()]))
            for i in np.flatnonzero(keep):
                keep[i] = sketches_differ(*(w[e[i] : e[i + 1]] for w, e in zip(words, ends))) <= most[i]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    there = pairs.join(profiles.select(F.col("sid").alias("b"), F.col("size").alias("size_b"), F.col("sketch").alias("sketch_b")), "b")
    there = there.join(profiles.select(F.col("sid").alias("a"), F.col("size").alias("size_a"), F.col("sketch").alias("sketch_a")), "a")
    return there.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(run, "a bigint, b bigint")


def similar(pairs: DataFrame, texts: DataFrame, similarity: float, width: int = 5) -> DataFrame:
    """Those pairs (a, b) of sids whose texts have a Jaccard similarity of ``similarity`` or more; two texts without
    words are equal.

    The many partners of one text meet it in the last join, so its text is not shuffled again for each of them.
    """

    def run(batches):
        last, of_last = None, None
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                a = batch.column(0)[i].as_py()
                if a != last:
                    last, of_last = a, shingle_hashes(batch.column(2)[i].as_py(), width)
                other = shingle_hashes(batch.column(3)[i].as_py(), width)
                total = len(of_last) + len(other)
                least, most = sorted((len(of_last), len(other)))
                if least < similarity * most:
                    continue
                both = len(np.intersect1d(of_last, other, assume_unique=True))
                keep[i] = total == 0 or both >= similarity * (total - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    there = pairs.join(texts.select(F.col("sid").alias("b"), F.col("text").alias("text_b")), "b")
    there = there.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("text_a")), "a")
    return there.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")
