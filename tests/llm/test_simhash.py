import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seatracks.llm import simhash as S

SCHEMA = "doc_id long, text string, source string"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if j < i and bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints():
    for text in ("a b c d", "A b C", "two words", "one", "", None, " \t\n", "é È Ü x y", "a b c " * 1000):
        assert S.fingerprint(text) == brute_fingerprint(text)


def test_golay_keys_meet_within_two_bits():
    golay, rng = S.Golay(), np.random.default_rng(0)
    v = rng.integers(0, 1 << 23, 300).astype(np.uint32)
    near = golay.leaders[S._syndromes(v)]
    assert all(bin(int(e)).count("1") <= 3 for e in near)  # a perfect code: every word decodes
    for flips in (0, 1, 2):
        u = v.copy()
        for _ in range(flips):
            u ^= np.uint32(1) << rng.integers(0, 23, len(u)).astype(np.uint32)
        for x, y in zip(v, u):
            a, b = (set(golay.keys(np.array([w]))[1].ravel()) for w in (x, y))
            assert a & b and len(a) <= 6


@pytest.mark.parametrize("limit", [64, 2])
def test_components_match_brute_force(spark, limit):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = set(base)
    for b in base:
        x = b
        for _ in range(rng.randrange(12)):
            x ^= 1 << rng.randrange(64)
            fps.add(x)
            fps.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = {i: f for i, f in enumerate(sorted(fps))}
    want = brute_components(signed)
    rows = [(int(np.uint64(f).astype(np.int64)), i) for i, f in signed.items()]
    nodes = spark.createDataFrame(rows, "fp long, id long")
    stars = {r["b"]: r["a"] for r in S.connected(S.near_links(nodes, limit)).collect()}
    roots = {i: stars.get(f, f) for f, i in rows}
    groups = lambda m: sorted(sorted(i for i in m if m[i] == r) for r in set(m.values()))
    assert groups(roots) == groups(want)


def test_chain_of_links_becomes_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["b"]: r["a"] for r in S.connected(links).collect()} == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_rows_with_odd_values(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text, "a"), (3, text.upper(), None), (9, text.replace("w150", "x"), "a"), (1, None, "a"), (2, " \n", "b"), (4, "", None), (7, "other words entirely here", "a"), (7, "other words entirely here", "a"), (None, text, "a")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit("mine")).withColumn("component_id", F.lit(0))
    got = S.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[5]["component_id"] == by[3]["component_id"] == by[None]["component_id"] == 3
    assert by[1]["fingerprint"] == "0" * 16 and {by[i]["component_id"] for i in (1, 2, 4)} == {1}
    assert by[7]["component_id"] == 7
    plain = spark.createDataFrame(rows, SCHEMA)
    left = sorted((r["doc_id"] is None, r["doc_id"]) for r in S.deduplicated(plain).collect())
    assert [x[1] for x in left if x[1] in (1, 2, 3, 4, 5, 7)] == [1, 3, 7]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.near_duplicates(empty).count() == 0 and S.deduplicated(empty).count() == 0


def test_query_on_table_matches_brute_force(spark, data):
    from seatracks.llm.queries import queries

    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows}
    want = brute_components(fps)
    got = queries()["op3_simhash"](spark, data).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_rows_that_share_ids_are_told_apart(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, text, "a"), (1, "quite another text that nothing is near to", "b"), (1, text, "c"), (2, text.upper(), "a"), (None, text, "a"), (None, "alone without an id", "a"), (None, None, "a"), (3, "", "a")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("_rid", "rid", "fp", "key", "component_id")})
    got = S.deduplicated(df)
    assert got.columns == df.columns
    left = sorted((r["doc_id"] or 0, r["text"]) for r in got.collect())
    assert left == sorted([(1, text), (1, "quite another text that nothing is near to"), (0, "alone without an id"), (3, "")])
