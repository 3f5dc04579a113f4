import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seatracks.llm import lm_scoring as M
from seatracks.llm.queries import queries
from seatracks.llm.tokens import WordTokens, default_tokenizer


def brute(texts, order, backoff=0.4, least=2):
    t = WordTokens(default_tokenizer()).tokenizer
    ids = [[M.START] * (order - 1) + t.encode(x or "", add_special_tokens=False).ids for x in texts]
    counts = [Counter() for _ in range(order + 1)]
    before = [Counter() for _ in range(order + 1)]
    for own in ids:
        for i in range(order - 1, len(own)):
            for n in range(1, order + 1):
                gram = tuple(own[i - n + 1 : i + 1])
                counts[n][gram] += 1
                before[n][gram[:-1]] += 1
    total = sum(counts[1].values())

    def score(gram):
        n = len(gram)
        if n == 1:
            return math.log(counts[1][gram] / total)
        if counts[n][gram] >= least:
            return math.log(counts[n][gram] / before[n][gram[:-1]])
        return math.log(backoff) + score(gram[1:])

    return [(len(own) - order + 1, sum(score(tuple(own[i - order + 1 : i + 1])) for i in range(order - 1, len(own)))) for own in ids]


TEXTS = ["the cat sat on the mat", "the cat sat", None, "", " \n", "the cat sat", "the the the the", "a mat on the cat " * 2000, "unique zygote"]


@pytest.mark.parametrize("order, chunk", [(2, 10**6), (3, 10**6), (2, 1), (4, 1)])
def test_scores_match_brute_force(spark, order, chunk):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("n", F.lit(0))
    got = {r["doc_id"]: r for r in M.scored(df, order=order, chunk_bytes=chunk).collect()}
    for i, (n, s) in enumerate(brute(TEXTS, order)):
        assert got[i]["n_tokens"] == n and got[i]["log_score"] == pytest.approx(s, abs=1e-5)
        assert got[i]["mean_log_score"] == (pytest.approx(s / n, abs=1e-5) if n else None)


def test_empty_table_and_repeated_ids(spark):
    assert M.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert M.scored(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")).count() == 3
    with pytest.raises(ValueError):
        M.scored(spark.createDataFrame([], "doc_id long, text string"), order=1)


def test_query_matches_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries()["op8_lm_scoring"](spark, data).collect()}
    for r, (n, s) in zip(rows, brute([r["text"] for r in rows], 2)):
        assert got[r["doc_id"]]["n_tokens"] == n and got[r["doc_id"]]["log_score"] == pytest.approx(s, abs=1e-4)
