import duckdb
import pytest
from pyspark.sql import functions as F

from seatracks.llm import mixing as M
from seatracks.llm.queries import oracle_sql, queries

SCHEMA = "doc_id long, text string, source string, n_chars long"


def fill(sizes, weights, share=1.5, cap=2.0):
    """Targets by repeated clamping."""
    total, target = share * sum(sizes), {}
    open_ = set(range(len(sizes)))
    while open_:
        level = (total - sum(target.values())) / sum(weights[i] for i in open_)
        over = {i for i in open_ if level * weights[i] > cap * sizes[i]}
        if not over:
            return [target.get(i, level * weights[i]) for i in range(len(sizes))]
        for i in over:
            target[i] = cap * sizes[i]
        open_ -= over
    return [target[i] for i in range(len(sizes))]


def corpus(spark, n=60):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i % 13 * 3)), [None, "b", "a", "ä", "Z"][i % 5], 7) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_targets_and_taken(spark):
    df, rows = corpus(spark)
    got = M.mix(df.withColumn("size", F.lit("clash")).withColumn("target", F.lit(0))).collect()
    order = sorted({r[2] for r in rows if r[2]}, key=lambda s: s.encode()) + [None]
    sizes = [sum(len(r[1].split()) for r in rows if r[2] == s) for s in order]
    want = dict(zip(order, fill(sizes, [M.WEIGHTS[i % 3] for i in range(len(order))])))
    assert len(got) == len(rows)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
    for s in order:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - want[s]) <= 1
    again = M.mix(df.repartition(7)).collect()
    assert {r["doc_id"]: r["taken"] for r in got} == {r["doc_id"]: r["taken"] for r in again}


def test_mix_holds_the_words_taken(spark):
    df, rows = corpus(spark)
    taken = {r["doc_id"]: r["taken"] for r in M.mix(df).collect()}
    out = M.sampled(df)
    assert out.columns == df.columns
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
    assert got == {i: n for i, n in taken.items() if n}


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert M.mix(empty).count() == 0 and M.sampled(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, 0), (2, "", "a", 0)], SCHEMA)
    assert sorted((r["size"], r["target"], r["taken"]) for r in M.mix(blank).collect()) == [(0, 0.0, 0)] * 2
    twice = spark.createDataFrame([(1, "a b c", "a", 0), (1, "a b c", "a", 0), (None, "d e", "a", 0), (2, "f " * 40_000, "b", 0)], SCHEMA)
    got = M.mix(twice).collect()
    assert len(got) == 4 and abs(sum(r["taken"] for r in got) - 1.5 * 40_008) <= 2
    assert all(r["taken"] <= 2 * r["size"] for r in got)


def test_query_matches_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{data}/documents.parquet')")
    want = con.execute(oracle_sql()["op7_mixing"]).df().sort_values("doc_id").reset_index(drop=True)
    got = queries()["op7_mixing"](spark, data).toPandas().sort_values("doc_id").reset_index(drop=True)
    for c in ("doc_id", "size", "source_size", "target", "taken"):
        assert (want[c] == got[c]).all(), c


def test_rows_that_share_ids_are_taken_by_themselves(spark):
    rows = [(1, f"a{i} b\n c{i}  d", "s", 0) for i in range(100)] + [(None, f"x{i}\ty z", None, 0) for i in range(50)] + [(1, "a0 b\n c0  d", "s", 0)] * 20
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(5) for c in ("_rid", "_n", "_part", "_size", "_taken", "size", "target", "taken", "order", "left", "cut")})
    mixed = M.mix(df).collect()
    out = M.sampled(df)
    assert out.columns == df.columns and len(mixed) == len(rows)
    got = out.collect()
    for s in ("s", None):
        want = sum(r["taken"] for r in mixed if r["source"] == s)
        assert sum(len(r["text"].split()) for r in got if r["source"] == s) == want
    texts = {r[1] for r in rows}
    assert all(r["text"] in texts or any(t.startswith(r["text"]) for t in texts) for r in got) and all(r["_n"] == 5 for r in got)


def test_a_crowd_at_the_cut_is_settled_by_the_texts(spark, monkeypatch):
    """All rows share one id: the cut is found among the hashes of their texts, to the word."""
    rows = [(1, " ".join(f"w{i}" for _ in range(1 + i % 7)), "ab"[i % 2], 0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(tuple(r) for r in M.mix(df).select("source", "target").distinct().collect())
    monkeypatch.setattr(M, "EDGE_ROWS", 10)
    got = M.mix(df).collect()
    assert sorted({(r["source"], r["target"]) for r in got}) == want and len(got) == 400
    for s, target in want:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - target) <= 1
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)


def test_an_id_column_called_like_a_result(spark):
    df, rows = corpus(spark)
    got = M.mix(df.withColumnRenamed("doc_id", "size"), id_col="size")
    assert got.columns == ["_size", "size", "source", "source_size", "target", "taken"] and got.count() == len(rows)


def test_the_documents_taken_do_not_depend_on_how_many_stand_at_the_cut(spark, monkeypatch):
    """Null ids, equal rows and different texts: settling the cut further takes the same rows."""
    rows = [(None, " ".join(f"w{i % 50}" for _ in range(1 + i % 50)), "ab"[i % 2], 0) for i in range(400)] + [(None, "same text here", "a", 0)] * 150
    df = spark.createDataFrame(rows, SCHEMA)
    taken = lambda: sorted(tuple(r) for r in M.mix(df.withColumn("t", F.col("text")), keep="t").select("t", "source", "size", "taken").collect())
    kept = lambda: sorted((r["source"], r["text"]) for r in M.sampled(df).collect())
    few, few_kept = taken(), kept()
    monkeypatch.setattr(M, "EDGE_ROWS", 10)
    assert taken() == few and kept() == few_kept
    words = {s: sum(r[3] for r in few if r[1] == s) for s in "ab"}
    assert {s: sum(len(t.split()) for o, t in few_kept if o == s) for s in "ab"} == words


def test_many_equal_rows_at_the_cut_are_taken_by_count(spark, monkeypatch):
    monkeypatch.setattr(M, "EDGE_ROWS", 10)
    df = spark.createDataFrame([(None, "one two three", "s", i) for i in range(1000)], SCHEMA).repartition(7)
    mixed = [r["taken"] for r in M.mix(df, mix_share=1.5).collect()]
    assert sum(mixed) == 4500 and set(mixed) == {3, 6} and mixed.count(6) == 500
    out = M.sampled(df, mix_share=1.5)
    assert out.count() == 1500 and out.select(df.columns[-1]).distinct().count() == 1000
