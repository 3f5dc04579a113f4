import re

import numpy as np
from pyspark.sql import functions as F

from seatracks.llm import neighbours as N
from seatracks.llm.queries import queries

SCHEMA = "vec_id long, embedding array<float>"


def exact(vectors, q, k):
    def dot(a, b):
        s = 0.0
        for x, y in zip(a, b):
            s += float(x) * float(y)
        return s

    return sorted(((-dot(vectors[q], v), i) for i, v in vectors.items() if i != q))[:k]


def as_float(x):
    return [float(np.float32(v)) for v in x]


def test_few_rows_are_searched_exactly_and_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(0)
    base = {i: as_float(rng.normal(size=5) * (1 + i % 3)) for i in range(60)}
    base |= {i: base[7] for i in range(100, 140)}
    odd = [(200, None), (201, [0.0] * 5), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [float("nan")] * 5), (204, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (205, [1.0, 2.0]), (206, []), (None, [1.0] * 5)]
    df = spark.createDataFrame(list(base.items()) + odd, SCHEMA).withColumn("id", F.lit("clash")).withColumn("score", F.lit(0))
    got = N.search(df, F.col("id") % 20 == 0, k=20, cell_rows=8).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == {0, 20, 40, 100, 120}
    for q, own in by.items():
        own.sort()
        want = exact(base, q, 20)
        assert [(v, s) for _, v, s in own] == [(i, -s) for s, i in want]
        assert [r for r, _, _ in own] == list(range(1, 21))


def test_fewer_rows_than_asked_for(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.25]), (2, [0.0, 1.0])], SCHEMA)
    got = [(r["rank"], r["vec_id"], r["score"]) for r in N.search(df, F.col("id") == 0).orderBy("rank").collect()]
    assert got == [(1, 1, 0.5), (2, 2, 0.0)]
    assert N.search(spark.createDataFrame([], SCHEMA), F.col("id") == 0).count() == 0
    assert N.search(spark.createDataFrame([(0, None)], SCHEMA), F.col("id") == 0).count() == 0
    assert N.search(spark.createDataFrame([(0, [1.0])], SCHEMA), F.col("id") == 0).count() == 0


def test_recall_where_not_all_leaves_are_searched(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = N.search(df, F.col("id") % 100 == 0, leaf_rows=16, cell_rows=100, bucket_rows=2000).toPandas()
    hits = 0
    for q, own in got.groupby("query_id"):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hits += (own.score >= np.sort(s)[-20] - 1e-9).sum()
    assert len(got) == 30 * 20 and hits / len(got) >= 0.9


def test_queries_are_dealt_to_bounded_groups_and_find_the_same(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, as_float(x)) for i, x in enumerate(rng.normal(size=(600, 6)))], SCHEMA)
    want = N.search(df, F.col("id") % 2 == 0, k=5, bucket_rows=1000).collect()
    found = N.search(df, F.col("id") % 2 == 0, k=5, bucket_rows=1000, query_rows=30)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(bucket#\d+L?, group#\d+L?", plan)) == 2
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want)) and len(want) == 300 * 5


def test_the_queue_gives_leaves_in_the_order_of_a_heap():
    import heapq

    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 8))
    forest = N.Forest([], float(np.linalg.norm(x, axis=1).max()))
    forest.trees = [N.grow(forest.with_rest(x), 10, rng) for _ in range(3)]
    for q, got in zip(x[:5], forest.queue(x[:5])):
        wide = np.append(q / np.linalg.norm(q) * forest.largest, 0.0)
        heap, want = [(0.0, k, 0) for k in range(3)], []
        while heap:
            way, k, node = heapq.heappop(heap)
            if node < 0:
                want.append((round(way, 9), int(forest.starts[k]) - node - 1))
                continue
            t = forest.trees[k]
            margin = float(t.directions[node] @ wide - t.thresholds[node])
            heapq.heappush(heap, (way + max(margin, 0.0) ** 2, k, int(t.children[node, 0])))
            heapq.heappush(heap, (way + max(-margin, 0.0) ** 2, k, int(t.children[node, 1])))
        ways = dict((leaf, way) for way, leaf in want)
        assert sorted(got) == sorted(ways) and [ways[i] for i in got] == [way for way, _ in want]


def test_clustered_vectors_need_few_candidates(spark):
    """The measured number of candidates: few where there is structure, and the recall that was asked for."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(60, 16))[rng.integers(0, 60, 6000)] + 0.1 * rng.normal(size=(6000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    vectors = N.usable(df, "vec_id", "embedding")
    forest = N.fit(vectors, 8, 64)
    leaves = forest.leaves(x.astype(float))
    placed = spark.createDataFrame([(i, [float(c) for c in v], leaf.tolist()) for i, (v, leaf) in enumerate(zip(x, leaves))], "id long, v array<double>, leaves array<long>")
    counts = np.bincount(leaves.ravel(), minlength=int(forest.starts[-1]))
    need = N.candidates_needed(forest, placed, vectors.where("id % 20 = 0"), counts, 20, 0.95, 64, 7)
    assert 20 <= need < 0.2 * counts.sum()
    got = N.search(df, F.col("id") % 20 == 0).toPandas()
    hits = 0
    for q, own in got.groupby("query_id"):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hits += (own.score >= np.sort(s)[-20] - 1e-9).sum()
    assert len(got) == 300 * 20 and hits / len(got) >= 0.9


def test_a_very_common_vector(spark):
    rng = np.random.default_rng(5)
    one = as_float(rng.normal(size=8))
    rows = [(i, one if i % 3 else as_float(rng.normal(size=8))) for i in range(900)]
    got = N.search(spark.createDataFrame(rows, SCHEMA), F.col("id") % 20 == 0, k=5, cell_rows=16, bucket_rows=500).collect()
    vectors, by = dict(rows), {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in (20, 40, 80):  # copies of the common vector: the others with the smallest ids
        assert [(v, s) for _, v, s in sorted(by[q])] == [(i, -s) for s, i in exact(vectors, q, 5)]
    assert len(got) == 45 * 5


def test_query_recall(spark, data):
    e = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()
    vectors = {r["vec_id"]: r["embedding"] for r in e}
    got = queries()["op10_neighbours"](spark, data).toPandas()
    hit = 0
    for q, own in got.groupby("query_id"):
        hit += len({i for _, i in exact(vectors, q, 20)} & set(own.vec_id))
    assert got.query_id.nunique() == sum(i % 20 == 0 for i in vectors) and hit / len(got) >= 0.9
