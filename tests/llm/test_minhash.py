import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatracks.llm import minhash as M
from seatracks.llm import simhash as S

SCHEMA = "doc_id long, text string, source string"


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_groups(texts, similarity):
    """The smallest id of each id's group, by all pairs."""
    ids, sets, root = sorted(texts), {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for i in ids:
        for j in ids:
            if j < i and root[i] != root[j] and jaccard(sets[i], sets[j]) >= similarity:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def prose(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def changed(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"x{rng.randrange(10**6)}"
    return words


def left(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(r["doc_id"] for r in S.deduplicated(df, similarity=0.8, **more).collect())


def test_shingle_hashes_tell_shingles_apart():
    for text in ("a b c d e f", "A b C d E f", "two words", "one", "", None, " \t\n", "é È Ü x y z", "a b c d e " * 500):
        assert len(M.shingle_hashes(text)) == len(shingles(text))
    assert list(M.shingle_hashes("a b c d e F")) == list(M.shingle_hashes(" a\tB c\nd e  f "))
    assert set(M.shingle_hashes("a b c d e")).isdisjoint(M.shingle_hashes("e d c b a"))
    assert len(M.band_keys(M.shingle_hashes("one two"))) == M.BANDS and not len(M.band_keys(M.shingle_hashes("")))


def test_bands_meet_as_often_as_stated():
    rng = np.random.default_rng(5)
    for similarity, least, most in ((0.8, 0.93, 1.0), (0.3, 0.0, 0.05)):
        met = 0
        for _ in range(200):
            both = round(450 * similarity)
            rest = (450 - both) // 2
            h = rng.integers(0, 1 << 63, both + 2 * rest, dtype=np.uint64)
            met += bool((M.band_keys(h[: both + rest]) == M.band_keys(np.concatenate([h[:both], h[both + rest :]]))).any())
        assert least <= met / 200 <= most


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(11)
    rows, texts = [], {}
    for base in range(25):
        words = prose(rng, rng.choice((60, 200, 900)))
        for copy, share in enumerate((0, 0, 0.005, 0.01, 0.02, 0.06)):
            rows.append((100 * base + copy, " ".join(changed(rng, words, int(share * len(words)))), "a"))
    rng.shuffle(rows)
    texts = {i: t for i, t, _ in rows}
    want = set(brute_groups(texts, 0.8).values())
    assert 25 < len(want) < 75  # some edits leave too little in common
    assert set(left(spark, rows)) == want


@pytest.mark.parametrize("limit", [2, 8])
def test_large_groups_and_chains(spark, limit):
    rng = random.Random(4)
    rows = []
    for base in range(2):
        words = prose(rng, 400)
        rows += [(1000 * base + i, " ".join(changed(rng, words, 3)), "a") for i in range(60)]
    words = prose(rng, 300)
    for i in range(30):  # each near the one before, the ends share nothing
        words = words[6:] + prose(rng, 6)
        rows.append((5000 + i, " ".join(words), "a"))
    texts = spark.createDataFrame([(i, t) for i, t, _ in rows], "sid long, text string")
    got = {r["sid"]: r["root"] for r in S.similar_texts(texts, 0.8, bucket_limit=limit).collect()}
    assert got == {i: i - i % 1000 for i, _, _ in rows}


def test_common_passages_link_nothing(spark):
    rng = random.Random(8)
    shared = prose(rng, 120)
    rows = [(i, " ".join(prose(rng, 60) + shared + prose(rng, 60)), "a") for i in range(40)]
    assert left(spark, rows) == list(range(40))


def test_rows_with_odd_values(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text, "a"), (3, text.upper(), None), (9, text.replace("w150", "x"), "a"), (1, None, "a"), (2, " \n", "b"), (4, "", None), (7, "few words", "a"), (7, "few words", "a"), (8, "Few  WORDS", "a"), (None, text, "a"), (None, "alone without an id", "a"), (6, "w " * 100_000, "a")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("sid", "row", "root", "_key", "_BODY", "a")})
    got = S.deduplicated(df, similarity=0.8)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == sorted([(3, text.upper()), (1, None), (7, "few words"), (0, "alone without an id"), (6, "w " * 100_000)], key=lambda x: x[0])
    assert S.deduplicated(df.limit(0), similarity=0.8).count() == 0


def test_prefixes_and_sketches_lose_nothing():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n, (gone, new) = int(rng.integers(1, 400)), rng.integers(0, rng.choice((4, 60)), 2)
        h = rng.integers(0, 1 << 63, n + 60, dtype=np.uint64) * np.uint64(2)
        x = np.unique(h[:n])
        y = np.unique(np.concatenate([x[rng.permutation(n) >= min(gone, n - 1)], h[n : n + new]]))
        common = rng.integers(0, 1 << 63, 1 << (M.COMMON_BITS - 6), dtype=np.uint64)  # any filter: half of the order turned
        both, either = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        assert M.sketches_differ(M.parity_sketch(x), M.parity_sketch(y)) <= either - both
        for marks in (None, common):
            if both >= 0.8 * either:
                a, b = M.prefix(x, 0.8, marks), M.prefix(y, 0.8, marks)
                at = [(i, int(np.flatnonzero(b == k)[0])) for i, k in enumerate(a) if k in b]
                assert at and min(len(x) - at[0][0], len(y) - at[0][1]) >= 0.8 / 1.8 * (len(x) + len(y)) - M.SLACK
    h = rng.integers(0, 1 << 63, 450, dtype=np.uint64)
    assert 600 / 9 < M.sketches_differ(M.parity_sketch(h[:300]), M.parity_sketch(h[150:])) <= 300  # and tell others apart


def test_filter_of_common_shingles(spark):
    keys = [0, 1 << 42, -1, -(1 << 63), (1 << 63) - 1, 77 << 45]
    common = M.common_shingles(spark.createDataFrame([(k,) for k in keys], "key long"))
    assert sum(map(int, np.bitwise_count(common))) == len(keys)
    x = np.sort(np.array([*keys, *(k ^ (1 << 50) for k in keys)], dtype=np.int64).view(np.uint64))
    assert list(M.prefix(x, 0.01, common)[len(keys) :].view(np.int64)) == sorted(keys, key=lambda k: k % (1 << 64))


def groups_of(spark, rows, **limits):
    texts = spark.createDataFrame(rows, "sid long, text string")
    found = {r["sid"]: r["root"] for r in S.similar_texts(texts, 0.8, **limits).collect()}
    return {i: found.get(i, i) for i, _ in rows}


def test_links_without_a_shared_band(spark):
    rng = random.Random(21)
    rows = []
    for i in range(250):  # 4 edits in 182 shingles: 20 of each are of their own, a similarity just above 0.8
        words = prose(rng, 186)
        other = list(words)
        for at in (20, 60, 100, 140):
            other[at] = f"x{i}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    want = {i: i - i % 2 for i, _ in rows}
    assert jaccard(shingles(rows[0][1]), shingles(rows[1][1])) < 0.802
    assert groups_of(spark, rows) == want


@pytest.mark.parametrize("crowd", [64, 3])
def test_no_link_of_a_large_bucket_is_lost(spark, crowd):
    rng = random.Random(6)
    shared = prose(rng, 170)
    rows = [(i, " ".join(shared + prose(rng, 22))) for i in range(240)]  # all meet in bands, at 0.79
    for i in (31, 77, 120, 158):  # with one more each that goes on with four equal words: 0.825
        rows.append((1000 + i, " ".join(rows[i][1].split()[:174] + prose(rng, 18))))
    want = brute_groups(dict(rows), 0.8)
    assert sum(want[i] != i for i in want) == 4
    assert groups_of(spark, rows, bucket_limit=2, crowd_limit=crowd) == want


def test_whole_texts_are_shuffled_once(spark):
    def shuffled():
        jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (found.apply(i) for i in range(found.size()))}

    rng = random.Random(13)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(rng.randrange(200, 600))) for _ in range(400)]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    for i in range(0, 400, 40):  # ten near copies
        words = texts[i].split()
        rows.append((1000 + i, " ".join(["x", *words[1:]]), "b"))
    df = spark.createDataFrame(rows, SCHEMA).localCheckpoint()
    before = set(shuffled())
    got = S.deduplicated(df, similarity=0.8).select("doc_id", "source").collect()
    assert sorted(map(tuple, got)) == [(i, "a") for i in range(400)]
    moved = sum(n for at, n in shuffled().items() if at not in before)
    assert moved < 1.6 * sum(len(t) for _, t, _ in rows)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("texts_")]
