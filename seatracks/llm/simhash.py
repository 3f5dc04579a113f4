"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprint: 64 bits, a bit is set if it is set in over half of the document's shingle hashes.
Search: the fingerprint is cut into segments of 23, 23 and 18 bits. The binary Golay code (23, 12, 7)
is perfect: each 23-bit word lies within 3 bits of exactly one codeword. A segment's keys are the
codewords that it, or it with any one bit flipped, decodes to. Two segments at 2 or fewer differing
bits share a key, since both decode the word halfway to the same codeword. By the pigeonhole
principle, of three segments with 2 errors in all one has none, so each fingerprint gets, for each
segment, keys made of that segment exactly and one Golay key of the next segment (3 to 18 keys of 35
bits). Documents that share a key are compared.

A bucket of up to ``bucket_limit`` fingerprints is compared pair by pair. Fingerprints of larger
buckets are linked exactly without pairs: two fingerprints differ in 2 or fewer bits if and only if
some 64-bit word lies within 1 bit of both, and at most 65 fingerprints lie within 1 bit of a word.

Only distinct fingerprints enter the search, so copies cost one row each. Components come from
alternating large-star and small-star rounds on the links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import minhash
from .common import free_name, text_chunks, written, written_by

#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GOLAY_POLYNOMIAL = 0b110001110101
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Rounds of a few texts of each large bucket against all others, before the exact search finds what is left.
HEAD_ROUNDS = 3
#: How often texts of frequent shingles get new prefixes before all their pairs are candidates.
ORDERS = 2
SEED = 42


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """Fingerprint of one text; 0 if it has no words."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle_words + 1)
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id_col, fp long) for each row; a null or blank text has fingerprint 0."""

    def run(batches):
        for batch in batches:
            for part in text_chunks(batch, "text"):
                fps = np.fromiter((fingerprint(t, shingle_words) for t in part.column(1).to_pylist()), dtype=np.uint64, count=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


def _syndromes(v: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    v = v.astype(np.uint32)
    for bit in range(22, 10, -1):
        v = v ^ (((v >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GOLAY_POLYNOMIAL << (bit - 11)))
    return v


def _coset_leaders() -> np.ndarray:
    """The error of weight 3 or less for each of the 2,048 syndromes."""
    errors = np.array([sum(1 << b for b in bits) for w in range(4) for bits in combinations(range(23), w)], dtype=np.uint32)
    leaders = np.zeros(2048, dtype=np.uint32)
    leaders[_syndromes(errors)] = errors
    return leaders


class Golay:
    def __init__(self):
        self.leaders = _coset_leaders()
        self.flips = np.array([0, *(1 << i for i in range(23))], dtype=np.uint32)

    def decode(self, v: np.ndarray) -> np.ndarray:
        """12-bit index of the nearest codeword (its upper bits: the code is systematic)."""
        return (v ^ self.leaders[_syndromes(v)]) >> np.uint32(11)

    def keys(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of each new key in its row's 24 sorted decodings as a mask, the sorted decodings)."""
        near = np.sort(self.decode(v.astype(np.uint32)[:, None] ^ self.flips[None, :]), axis=1)
        first = np.ones(near.shape, dtype=bool)
        first[:, 1:] = near[:, 1:] != near[:, :-1]
        return first, near


def fuzzy_keys(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key) for all keys of unsigned 64-bit fingerprints."""
    parts = [(fps >> np.uint64(at)) & np.uint64((1 << width) - 1) for at, width in SEGMENTS]
    rows, keys = [], []
    for i, exact in enumerate(parts):
        first, near = golay.keys(parts[(i + 1) % 3])
        row, col = np.nonzero(first)
        rows.append(row)
        keys.append((np.uint64(i) << np.uint64(35)) | (exact[row] << np.uint64(12)) | near[row, col].astype(np.uint64))
    return np.concatenate(rows), np.concatenate(keys)


def keyed(fps: DataFrame) -> DataFrame:
    """(key long, fp long): the fuzzy keys of distinct fingerprints."""

    def run(batches):
        golay = Golay()
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            row, key = fuzzy_keys(fp.view(np.uint64), golay)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[row])], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key bigint, fp bigint")


def near_links(distinct_fps: DataFrame, bucket_limit: int = 64) -> DataFrame:
    """Links (a < b) that connect all distinct fingerprints at 2 or fewer differing bits.

    Pairs of small buckets are all there; for large buckets, enough links that each such pair is connected.
    """
    keys = written(keyed(distinct_fps), "keys")
    sizes = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = written(keys.join(sizes, "key"), "shared")
    small = shared.where(F.col("n") <= bucket_limit).select("key", "fp")
    pairs = (
        small.select("key", F.col("fp").alias("a"))
        .join(small.select("key", F.col("fp").alias("b")), "key")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
        .select("a", "b")
    )
    crowd = shared.where(F.col("n") > bucket_limit).select("fp").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *(F.lit(np.uint64(1 << i).astype(np.int64).item()) for i in range(64)))
    halfway = crowd.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    met = halfway.groupBy("point").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return written(pairs.unionByName(stars).distinct(), "links")


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(b, a): each linked node b and the smallest node a of its component, a itself left out.

    Large-star and small-star rounds until the links are stars. The per-node minima are written as
    tables, so the joins with hub nodes are joins of two plain tables whose hot side can be split.
    """
    links = written(links.where("a < b").distinct(), "links")
    for _ in range(max_rounds):
        if _are_stars(links):
            return links.select("b", "a")
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        large = written(large, "large")
        least = written(large.groupBy("b").agg(F.min("a").alias("m")), "least")
        moved = large.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        links = written(moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct(), "small")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _are_stars(links: DataFrame) -> bool:
    """Whether each b has one a and no a is a b: then each a is the smallest of its component."""
    ends = links.groupBy("b").agg(F.count("*").alias("n"))
    hubs = links.select(F.col("a").alias("b")).distinct()
    return ends.where("n > 1").isEmpty() and hubs.join(ends, "b").isEmpty()


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, bucket_limit: int = 64) -> DataFrame:
    """(id_col, fingerprint, component_id) for each row of ``df``.

    component_id is the smallest id reachable over links of 2 or fewer differing bits. Null and blank
    texts have fingerprint zero and link like any other; whole texts count, however long; repeated rows share
    everything; a null id is ignored when the smallest is sought (null if all are); an empty table gives an empty result;
    other columns of ``df`` do not matter.
    """
    fps = written(fingerprints(df, id_col, text_col, shingle_words), "fps")
    nodes = written(fps.groupBy("fp").agg(F.min(id_col).alias("first_id")), "nodes")
    stars = written(connected(near_links(nodes, bucket_limit)), "stars")
    members = stars.select(F.col("b").alias("fp"), F.col("a").alias("root")).unionByName(stars.select(F.col("a").alias("fp"), F.col("a").alias("root")).distinct())
    members = written(members.join(nodes, "fp"), "members")
    roots = written(members.groupBy("root").agg(F.min("first_id").alias("component_id")), "roots")
    linked = written(members.select("fp", "root").join(roots, "root").select("fp", "component_id"), "linked")
    of_fp = written(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "components")
    return fps.join(of_fp, "fp").select(id_col, hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def _members(links: DataFrame) -> DataFrame:
    """(sid, root) of all linked texts, the smallest of each component included."""
    stars = connected(links)
    members = stars.select(F.col("b").alias("sid"), F.col("a").alias("root"))
    return written(members.unionByName(stars.select(F.col("a").alias("sid"), F.col("a").alias("root")).distinct()), "members")


def _joined(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` with the links ``found`` added."""
    return _members(members.select(F.col("root").alias("a"), F.col("sid").alias("b")).unionByName(found))


def similar_texts(texts: DataFrame, similarity: float, width: int = 5, bucket_limit: int = 8, crowd_limit: int = 64) -> DataFrame:
    """(sid, root): the texts that have a near copy, each with the smallest sid of its group.

    ``texts``: (sid long, text string), each sid once; of a table in buckets of sid only the texts of candidates are shuffled.
    Whole texts decide, by the Jaccard similarity of their shingles of ``width`` words, and no link that would join two
    groups is lost.

    Most links are found first: among the texts within 2 bits by their Golay keys and those that share a MinHash band. In
    a bucket of up to ``bucket_limit`` texts all pairs are candidates, in a larger one its first text with each other
    one; then a text of each of ``bucket_limit`` groups against all texts of the others, chosen anew in each of up to
    ``HEAD_ROUNDS`` rounds.

    What these leave, however much, is found exactly, by the shingles of the texts' prefixes (see ``minhash``): all pairs of texts of
    different groups that share one are candidates. Where more than ``crowd_limit`` texts share one, its texts get
    prefixes anew, with such shingles last in the order, up to ``ORDERS`` times; then all pairs of the rest are candidates.
    """
    fps = written(fingerprints(texts, "sid", "text"), "fps")
    first = written(fps.groupBy("fp").agg(F.min("sid").alias("first")), "first")
    equal = fps.join(first, "fp").where("sid > first").select(F.col("first").alias("a"), F.col("sid").alias("b"))
    ends = near_links(first).join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a")
    ends = ends.join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    near = ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    profiles = written(minhash.profiled(texts, similarity, width), "profiles")
    keys = profiles.select(F.explode("bands").alias("key"), "sid")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("sid").alias("head")).where("n > 1")
    shared = written(keys.join(sizes, "key"), "shared")
    few = shared.where(F.col("n") <= bucket_limit)
    pairs = few.select("key", F.col("sid").alias("a")).join(few.select("key", F.col("sid").alias("b")), "key").where("a < b").select("a", "b")
    many = shared.where(F.col("n") > bucket_limit).select("key", "sid", "head")
    heads = many.where("sid > head").select(F.col("head").alias("a"), F.col("sid").alias("b"))
    pairs = equal.unionByName(near).unionByName(pairs).unionByName(heads).distinct()

    def of(sids: DataFrame) -> DataFrame:
        return texts.select("sid", "text").join(sids.distinct().hint("shuffle_hash"), "sid", "left_semi")

    def similar(pairs: DataFrame) -> DataFrame:
        pairs = written(minhash.may_be_similar(pairs, profiles, similarity), "pairs")
        bodies = of(pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))))
        found = minhash.similar(pairs, bodies.repartition("sid"), similarity, width)  # one exchange for both its joins
        return written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "links")

    members = _members(similar(pairs))
    for turn in range(1, HEAD_ROUNDS + 1):
        placed = many.join(members, "sid", "left").select("key", "sid", F.coalesce("root", "sid").alias("root"))
        order = F.struct(F.xxhash64("sid", F.lit(turn)), "sid")
        heads = placed.groupBy("key", F.col("root").alias("of_h")).agg(F.min(order).alias("head"))
        nth = F.row_number().over(Window.partitionBy("key").orderBy("head"))
        heads = heads.withColumn("nth", nth).where(F.col("nth") <= bucket_limit).select("key", F.col("head.sid").alias("h"), "of_h")
        open_ = placed.join(heads, "key").where("root != of_h")
        found = similar(open_.select(F.col("h").alias("a"), F.col("sid").alias("b")).distinct())
        if found.isEmpty():
            break
        members = _joined(members, found)

    left, common = profiles, np.zeros(1 << (minhash.COMMON_BITS - 6), dtype=np.uint64)
    for turn in range(ORDERS + 1):
        last = turn == ORDERS
        rooted = left.join(members, "sid", "left").select("sid", "size", F.coalesce("root", "sid").alias("root"), "prefix")
        shared = written(minhash.shared_postings(rooted), "shared")
        found = similar(minhash.prefix_pairs(shared if last else shared.where(F.col("n") <= crowd_limit), similarity))
        if not found.isEmpty():
            members = _joined(members, found)
        crowd = shared.where(F.col("n") > crowd_limit)
        if last or crowd.isEmpty():
            return members
        common = common | minhash.common_shingles(crowd.select("key"))
        left = minhash.prefixed(of(crowd.select("sid")), similarity, width, common)


def deduplicated(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, similarity: float | None = None, similar_words: int = 5
) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id; ids that are null come last.

    Without ``similarity`` fingerprints of shingles of ``shingle_words`` link at 2 or fewer differing bits, as in
    ``near_duplicates``; with it, texts link whose shingles of ``similar_words`` have at least that Jaccard similarity.
    Rows are told apart by id and text: rows that share an id with different texts are documents of their own, of rows
    that share both one stays. Null and blank texts are one group; whole texts count; columns of ``df`` may have any names;
    an empty table gives an empty result.
    """
    columns = df.columns
    key, body = free_name(columns, "_key"), free_name(columns, "_body")
    row = F.struct(F.col(id_col).isNull().alias("unknown"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body"))
    if similarity is not None:  # whole rows are shuffled once, here
        rows = df.select(row.alias("row"), F.struct(*columns).alias("whole"))
        texts = rows.groupBy(F.col("row.body").alias("sid")).agg(F.min("row").alias("row"), F.min_by("whole", "row").alias("whole"))
        texts = written_by(texts, "sid", "texts")
        groups = similar_texts(texts.select("sid", F.col("whole").getField(text_col).alias("text")), similarity, similar_words)
        found = texts.select("sid", "row").join(groups, "sid", "left")
        kept = found.groupBy(F.coalesce("root", "sid")).agg(F.min("row").alias("row")).select(F.col("row.body").alias("sid"))
        return texts.join(written(kept, "kept").hint("shuffle_hash"), "sid", "left_semi").select("whole.*")
    rows = df.select(row.alias("row"), F.col(text_col).alias("text"))
    firsts = near_duplicates(rows, "row", "text", shingle_words).where("row = component_id").select("row")
    kept = firsts.select(F.col("row.id").alias(key), F.col("row.body").alias(body)).distinct()
    kept = written(kept, "kept").hint("merge")  # as a broadcast would shuffle no texts in a small table only
    keyed = df.withColumn(body, F.xxhash64(text_col))
    left = keyed.join(kept, keyed[id_col].eqNullSafe(kept[key]) & (keyed[body] == kept[body]), "left_semi")
    return left.dropDuplicates([id_col, body]).select(columns)
