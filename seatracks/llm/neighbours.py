"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

Vectors get one more coordinate, ``sqrt(M^2 - |x|^2)`` with M the largest norm, and queries a zero, so
that the largest inner product is the smallest angle. Trees are fitted on a bounded sample (their
splits: the direction between two random sample vectors, at the median) down to leaves of about ``leaf_rows`` rows of
the table, or of two sample rows; then every row is assigned to its leaf in each tree. A query's leaves of all trees
come out of one priority queue, ordered by the sum of the squared margins by which the query misses them on the way
down, until they hold enough candidates. All candidates are scored exactly in double precision.

How many candidates are enough is measured: for a few queries the exact neighbours over all rows are found, block by
block, and the number is the one with which the forest reaches ``target_recall`` of them. Clustered vectors need few
candidates, whatever the table's size; vectors without structure need a large share of all rows.

A leaf is dealt out in cells of about ``cell_rows`` rows by a hash of the id, so a leaf full of copies is many cells,
and cells that follow one another, hence are near in their tree, are put together to buckets of about ``bucket_rows``
rows. A query goes once to each bucket that holds cells it probes. Where more than ``query_rows`` queries go to a bucket
they are dealt to groups and its rows are repeated for each: what one task holds is bounded on both sides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


@dataclass
class Tree:
    """Inner nodes: directions, thresholds and two children; a child below 0 is leaf ``-child - 1``."""

    directions: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    n_leaves: int

    def misses(self, x: np.ndarray) -> np.ndarray:
        """For each row of ``x`` and leaf: the sum of the squared margins of the splits whose other side the row is on."""
        if not len(self.directions):
            return np.zeros((len(x), 1))
        margin = x @ self.directions.T - self.thresholds
        at, out = np.zeros((len(x), len(self.directions))), np.zeros((len(x), self.n_leaves))
        level = np.zeros(1, dtype=np.int64)
        while len(level):  # nodes of one depth at a time
            below = []
            for side, sign in ((0, 1.0), (1, -1.0)):
                child = self.children[level, side]
                way = at[:, level] + np.maximum(sign * margin[:, level], 0.0) ** 2
                out[:, -child[child < 0] - 1] = way[:, child < 0]
                at[:, child[child >= 0]] = way[:, child >= 0]
                below.append(child[child >= 0])
            level = np.concatenate(below)
        return out

    def leaves(self, x: np.ndarray) -> np.ndarray:
        if not len(self.directions):
            return np.zeros(len(x), dtype=np.int64)
        at = np.zeros(len(x), dtype=np.int64)
        going = np.arange(len(x))
        while len(going):
            node = at[going]
            side = (np.einsum("ij,ij->i", x[going], self.directions[node]) > self.thresholds[node]).astype(np.int64)
            at[going] = self.children[node, side]
            going = going[at[going] >= 0]
        return -at - 1


def grow(sample: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> Tree:
    directions, thresholds, children, n_leaves = [], [], [], 0

    def split(own: np.ndarray) -> int:
        nonlocal n_leaves
        if len(own) > leaf_rows:
            for _ in range(3):
                a, b = sample[rng.choice(own, 2, replace=False)]
                line = a - b
                size = np.linalg.norm(line)
                if size == 0:
                    continue
                line = line / size
                where = sample[own] @ line
                cut = float(np.median(where))
                right = where > cut
                if right.any() and not right.all():
                    node = len(directions)
                    directions.append(line)
                    thresholds.append(cut)
                    children.append([0, 0])
                    children[node][0] = split(own[~right])
                    children[node][1] = split(own[right])
                    return node
        n_leaves += 1
        return -n_leaves

    split(np.arange(len(sample)))
    width = sample.shape[1]
    return Tree(np.array(directions).reshape(-1, width), np.array(thresholds), np.array(children, dtype=np.int64).reshape(-1, 2), n_leaves)


@dataclass
class Forest:
    trees: list[Tree]
    largest: float

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([t.n_leaves for t in self.trees])])

    def with_rest(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.largest**2 - np.einsum("ij,ij->i", x, x), 0.0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree, numbered through all trees."""
        wide = self.with_rest(x)
        return np.stack([start + t.leaves(wide) for t, start in zip(self.trees, self.starts)], axis=1)

    def queue(self, queries: np.ndarray):
        """For each query, all leaves in the order in which the shared priority queue gives them out.

        A leaf's priority is never before that of a node above it, so the queue gives leaves in the order of their own.
        """
        wide = np.concatenate([queries / np.maximum(np.linalg.norm(queries, axis=1), 1e-300)[:, None] * self.largest, np.zeros((len(queries), 1))], axis=1)
        for i in range(0, len(wide), 64):
            yield from np.argsort(np.concatenate([t.misses(wide[i : i + 64]) for t in self.trees], axis=1), axis=1, kind="stable")


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the rows with an id whose vector is neither null nor zero and has only finite components."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).alias("id"), v.alias("v"), fine.alias("fine")).where("id IS NOT NULL AND v IS NOT NULL AND fine").where(F.exists("v", lambda x: x != 0)).select("id", "v")


def matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def fit(vectors: DataFrame, trees: int = 8, leaf_rows: int = 64, sample_rows: int = 20_000, seed: int = 7) -> Forest:
    """Fit on at most about ``sample_rows`` vectors, picked by a hash of the id (all, if fewer).

    Leaves hold about ``leaf_rows`` rows of the table as long as these are two sample rows or more: up to
    ``leaf_rows / 2 * sample_rows`` rows; in larger tables they grow with it unless the sample does.
    """
    stats = vectors.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("most")).first()
    if not stats["n"]:
        return Forest([], 0.0)
    share = min(1.0, sample_rows / stats["n"])
    unit = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = vectors.where(unit < share).orderBy("id").select("v").toPandas()
    rng = np.random.default_rng(seed)
    forest = Forest([], float(np.sqrt(stats["most"])))
    if not len(sample):
        return Forest([Tree(np.zeros((0, 1)), np.zeros(0), np.zeros((0, 2), dtype=np.int64), 1)], forest.largest)
    wide = forest.with_rest(np.stack(sample["v"].to_numpy()).astype(np.float64))
    forest.trees = [grow(wide, max(2, round(leaf_rows * share)), rng) for _ in range(trees)]
    return forest


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``q`` and ``x``, summed in one order, so that equal vectors get equal scores."""
    score = np.zeros(len(q))
    for d in range(x.shape[1]):
        score += q[:, d] * x[:, d]
    return score


class Best:
    """The ``k`` best rows of each query so far: (query, row, score), ties to the smaller row."""

    def __init__(self, q: np.ndarray, x: np.ndarray, own: np.ndarray, k: int):
        self.q, self.x, self.own, self.k = q, x, own, k  # own: the row that is the query itself, or -1
        self.kth = np.full(len(q), -np.inf)
        self.kept = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def offer(self, queries: np.ndarray, rows: np.ndarray) -> None:
        """All pairs of some queries and candidate rows; those that may be among the best are looked at again."""
        near = self.q[queries] @ self.x[rows].T
        i, j = np.nonzero(near >= _about(self.kth[queries])[:, None])
        self.new.append((queries[i], rows[j], near[i, j]))
        self.waiting += len(i)
        if self.waiting > 1 << 18:
            self.settle()

    def settle(self) -> None:
        if not self.new:
            return
        query, row, near = (np.concatenate(c) for c in zip(*self.new))
        self.new, self.waiting = [], 0
        pair, at = np.unique(query * len(self.x) + row, return_index=True)
        fresh = ~np.isin(pair, self.kept[0] * len(self.x) + self.kept[1], assume_unique=True)
        query, row, near = query[at[fresh]], row[at[fresh]], near[at[fresh]]
        other = row != self.own[query]
        query, row, near = query[other], row[other], near[other]
        turn = np.lexsort((-near, query))
        query, row, near = query[turn], row[turn], near[turn]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kth = np.full(len(self.q), -np.inf)
        kth[query[rank == self.k - 1]] = near[rank == self.k - 1]
        close = near >= _about(kth[query])  # only these are scored in one order of summing
        query, row = query[close], row[close]
        score = np.concatenate([self.kept[2], *(exact_scores(self.q[query[i : i + 65536]], self.x[row[i : i + 65536]]) for i in range(0, len(query), 65536))])
        query, row = np.concatenate([self.kept[0], query]), np.concatenate([self.kept[1], row])
        turn = np.lexsort((row, -score, query))
        query, row, score = query[turn], row[turn], score[turn]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        self.kth[query[rank == self.k - 1]] = score[rank == self.k - 1]
        self.kept = query[rank < self.k], row[rank < self.k], score[rank < self.k]


def _about(score: np.ndarray) -> np.ndarray:
    """A little less, by more than the order of summing makes."""
    return score - 1e-9 * np.maximum(1.0, np.where(np.isfinite(score), np.abs(score), 1.0))


def candidates_needed(forest: Forest, placed: DataFrame, asking: DataFrame, counts: np.ndarray, k: int, target_recall: float, tried: int, seed: int) -> int:
    """Rows, counted over all trees, that the queue must give out so that ``target_recall`` of the exact neighbours are among them.

    Measured on about ``tried`` queries against all rows: a stated, bounded query set, in blocks.
    """
    some = asking.orderBy(F.xxhash64("id", F.lit(seed + 3)), "id").limit(tried).toPandas()
    if not len(some):
        return 0
    q, names = np.stack(some["v"].to_numpy()).astype(np.float64), some["id"].to_numpy()

    def block(batches):
        for batch in batches:
            x, ids = matrix(batch.column(1)), batch.column(0).to_pandas().to_numpy()
            near = q @ x.T
            near[names[:, None] == ids[None, :]] = -np.inf
            best = np.argsort(-near, axis=1, kind="stable")[:, :k]
            rows = pa.array(best.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), best.shape[1])), pa.array(np.take_along_axis(near, best, axis=1).ravel()), batch.column(0).take(rows), batch.column(2).take(rows)], names=["q", "score", "id", "leaves"])

    kind = placed.schema["id"].dataType.simpleString()
    best = placed.select("id", "v", "leaves").mapInArrow(block, f"q bigint, score double, id {kind}, leaves array<bigint>").where(F.col("score") > float("-inf"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "id"))
    truth = best.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "leaves").toPandas()  # k rows for each query tried
    needed = []
    for i, order in enumerate(forest.queue(q)):
        held = np.empty(len(order), dtype=np.int64)
        held[order] = np.cumsum(counts[order])
        needed += [int(held[np.asarray(x)].min()) for x in truth["leaves"][truth["q"] == i]]
    return int(np.quantile(needed, target_recall, method="higher")) if needed else 0


def search(
    df: DataFrame,
    queries,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    trees: int = 8,
    leaf_rows: int = 64,
    sample_rows: int = 20_000,
    target_recall: float = 0.95,
    tried: int = 64,
    candidates: int | None = None,
    cell_rows: int = 512,
    bucket_rows: int = 32_768,
    query_rows: int = 8192,
    seed: int = 7,
) -> DataFrame:
    """(query_id, rank, id_col, score): the ``k`` nearest found for the rows that the condition ``queries`` (on column id) picks.

    Candidates: ``candidates`` rows counted over all trees, or without it as many as ``target_recall`` needs on ``tried``
    queries; four leaves of each tree at least. Vectors that are null, zero or hold null or non-finite components, and
    vectors of another dimension than the most usual (of equally usual ones the largest), take no part. Ties go to the
    smaller id. Of rows that repeat an id, that with the largest vector (element by element) counts. Other columns do not
    matter. An empty table gives an empty result.
    """
    spark = df.sparkSession
    vectors = written(usable(df, id_col, vector_col).groupBy("id").agg(F.max("v").alias("v")), "vectors")
    usual = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d")).alias("m")).select("m.*").first()
    kind = vectors.schema["id"].dataType.simpleString()
    schema = f"query_id {kind}, id {kind}, score double"
    if usual["n"] is None:
        return spark.createDataFrame([], schema).select("query_id", F.lit(0).alias("rank"), F.col("id").alias(id_col), "score")
    vectors = vectors.where(F.size("v") == usual["d"])
    forest = fit(vectors, trees, leaf_rows, sample_rows, seed)
    n_leaves = int(forest.starts[-1])

    def assign(batches):
        for batch in batches:
            leaf = forest.leaves(matrix(batch.column(1)))
            leaf = pa.ListArray.from_arrays(pa.array(np.arange(len(leaf) + 1) * leaf.shape[1], pa.int32()), pa.array(leaf.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, leaf], names=["id", "v", "salt", "leaves"])

    salted = vectors.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 30)))
    placed = written(salted.mapInArrow(assign, f"id {kind}, v array<double>, salt bigint, leaves array<bigint>"), "placed")
    sizes = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).collect()  # at most as many numbers as the forest has leaves
    counts = np.zeros(n_leaves, dtype=np.int64)
    for r in sizes:
        counts[r["leaf"]] = r["n"]
    asking = vectors.where(queries)
    if candidates is None:
        candidates = candidates_needed(forest, placed, asking, counts, k, target_recall, tried, seed)
    enough = max(candidates, len(forest.trees) * max(4 * leaf_rows, k + 1))

    blocks = np.maximum(1, -(-counts // cell_rows))
    cells = np.concatenate([[0], np.cumsum(blocks)])  # number of a leaf's first cell
    n_buckets = max(1, int(-(-counts.sum() // bucket_rows)))
    rows_before = np.concatenate([[0], np.cumsum(np.repeat(counts / blocks, blocks))])[:-1]
    bucket_of = np.minimum(n_buckets - 1, (rows_before / max(1.0, counts.sum() / n_buckets)).astype(np.int64))

    def probe(batches):
        for batch in batches:
            row, bucket, own = [], [], []
            for i, order in enumerate(forest.queue(matrix(batch.column(1)))):
                leaves = order[: int(np.searchsorted(np.cumsum(counts[order]), enough)) + 1]
                leaves = np.sort(leaves[counts[leaves] > 0])
                n = blocks[leaves]
                cell = np.repeat(cells[leaves] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                of = bucket_of[cell]
                starts = np.flatnonzero(np.diff(of, prepend=-1))
                row += [i] * len(starts)
                bucket += of[starts].tolist()
                own += np.split(cell, starts[1:])
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(own, pa.list_(pa.int64())), batch.column(0).take(at), batch.column(1).take(at)], names=["bucket", "cells", "id", "v"])

    asked = written(asking.mapInArrow(probe, f"bucket bigint, cells array<bigint>, id {kind}, v array<double>"), "asked")
    groups = np.zeros(n_buckets, dtype=np.int64)
    for r in asked.groupBy("bucket").agg(F.count("*").alias("n")).collect():  # one number for each bucket
        groups[r["bucket"]] = -(-r["n"] // query_rows)

    def deal(batches):
        for batch in batches:
            leaves = matrix(batch.column(3)).astype(np.int64)
            salt = batch.column(2).to_numpy(zero_copy_only=False)
            cell = (cells[leaves] + salt[:, None] % blocks[leaves]).ravel()
            bucket, row = bucket_of[cell], np.repeat(np.arange(batch.num_rows), leaves.shape[1])
            again = groups[bucket]  # a copy for each group of queries; none where nobody asks
            group = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
            at = pa.array(np.repeat(row, again))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(bucket, again)), pa.array(group), pa.array(np.repeat(cell, again)), batch.column(0).take(at), batch.column(1).take(at)], names=["bucket", "group", "cell", "id", "v"])

    def regroup(batches):
        for batch in batches:
            bucket, salt = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(salt % np.maximum(1, groups[bucket])), *batch.columns[2:]], names=["bucket", "group", "cells", "id", "v"])

    def nearest(own: pa.Table, asking: pa.Table) -> pa.Table:
        if not own.num_rows or not asking.num_rows:
            return pa.table([asking.column("id")[:0], own.column("id")[:0], pa.array([], pa.float64())], names=["query_id", "id", "score"])
        coded = own.column("id").combine_chunks().dictionary_encode()
        turn = pc.sort_indices(coded.dictionary)  # rows in the order of their ids, each once
        names = coded.dictionary.take(turn)
        place = np.empty(len(names), dtype=np.int64)
        place[turn.to_numpy()] = np.arange(len(names))
        who = place[coded.indices.to_numpy(zero_copy_only=False)]
        v, x = matrix(own.column("v")), np.zeros((len(names), usual["d"]))
        x[who] = v
        cell = own.column("cell").to_numpy()
        by_cell = np.argsort(cell, kind="stable")
        cell, who = cell[by_cell], who[by_cell]
        lists = asking.column("cells").combine_chunks()
        probed, asker = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(asking.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        by_cell = np.argsort(probed, kind="stable")
        probed, asker = probed[by_cell], asker[by_cell]
        self_at = pc.fill_null(pc.index_in(asking.column("id").combine_chunks(), value_set=names), -1).to_numpy(zero_copy_only=False)
        best = Best(matrix(asking.column("v")), x, self_at, k)
        at = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1])
        for c, i, j in zip(cell[at], at, [*at[1:], len(cell)]):
            mine = asker[np.searchsorted(probed, c) : np.searchsorted(probed, c, side="right")]
            for q in range(0, len(mine), 1024):
                best.offer(mine[q : q + 1024], who[i:j])
        best.settle()
        query, row, score = best.kept
        return pa.table([asking.column("id").combine_chunks().take(pa.array(query)), names.take(pa.array(row)), pa.array(score)], names=["query_id", "id", "score"])

    dealt = placed.mapInArrow(deal, f"bucket bigint, group bigint, cell bigint, id {kind}, v array<double>")
    asked = asked.select("bucket", F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(1 << 30)).alias("salt"), "cells", "id", "v").mapInArrow(regroup, f"bucket bigint, group bigint, cells array<bigint>, id {kind}, v array<double>")
    found = dealt.groupBy("bucket", "group").cogroup(asked.groupBy("bucket", "group")).applyInArrow(nearest, schema)
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
