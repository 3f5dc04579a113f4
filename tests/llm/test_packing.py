import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatracks.llm import packing as P
from seatracks.llm.queries import queries
from seatracks.llm.tokens import WordTokens, default_tokenizer


def check_layout(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 256])
    histogram = {n: rng.randrange(1, 30) for n in rng.sample(range(1, capacity + 1), capacity // 2)}
    plan = P.make_plan(histogram, capacity)
    placed, free = {n: set() for n in histogram}, {}
    for length, first, last, sequence, offset in plan.lines:
        for k in range(first, last):
            assert k not in placed[length]
            placed[length].add(k)
            free.setdefault(sequence + k - first, []).append((offset, length))
    assert {n: len(s) for n, s in placed.items()} == histogram
    assert all(s == set(range(len(s))) for s in placed.values())
    rows = [{"sequence_id": s, "offset": o, "length": n} for s, own in free.items() for o, n in own]
    used = check_layout(rows, capacity)
    total = sum(n * k for n, k in histogram.items())
    least = max(-(-total // capacity), sum(k for n, k in histogram.items() if 2 * n > capacity))  # no two long pieces share
    assert used == plan.n_sequences <= 1.15 * least + 1


def test_exact_complements_are_used():
    assert P.make_plan({7: 2, 3: 2}, 10).n_sequences == 2
    assert P.make_plan({6: 1, 3: 1, 1: 1}, 10).n_sequences == 1
    assert P.make_plan({5: 1, 2: 2, 1: 1}, 10).n_sequences == 1
    assert P.make_plan({5: 4}, 10).n_sequences == 2
    assert P.make_plan({}, 10).n_sequences == 0


@pytest.mark.parametrize("remember", [0, 40, 10_000])
def test_remembered_words_keep_their_ids(remember):
    import pyarrow as pa

    rng = random.Random(remember)
    plain, t = WordTokens(default_tokenizer()).tokenizer, WordTokens(default_tokenizer(), remember)
    words = ["alpha", "Beta,", "3.5%", "été.", "中文", "don't", "<|endoftext|>", "İx", "y" * 50, *map(str, range(30))]
    for _ in range(20):
        texts = [" ".join(rng.choices(words, k=rng.randrange(12))) for _ in range(rng.randrange(4))] + [None]
        ids, offsets = t.of_texts(pa.array(texts, pa.string()))
        assert t.held <= remember and len(t.known) == len(t.starts)
        for i, text in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_tokens_of_words_are_those_of_texts():
    import pyarrow as pa

    t = WordTokens(default_tokenizer())
    texts = ["Hello, World. It's 3.5% off!", None, "", "  a\n\tb ", "É<|endoftext|>x <|ENDOFTEXT|> y", "don't.stop,now", "中文 text", "x" * 300, "A.B.C. we're I'LL", "a b c"]
    ids, offsets = t.of_texts(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == t.tokenizer.encode(text or "", add_special_tokens=False).ids, text
    ids, offsets = t.of_texts(pa.array(["Plain words, here. It's"]))
    assert ids.tolist() == t.tokenizer.encode("Plain words, here. It's", add_special_tokens=False).ids


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (3, "word " * 9000), (None, "a b"), (4, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("clash")).withColumn("length", F.lit(-1))
    got = P.pack(df).collect()
    check_layout(got, P.CAPACITY)
    assert sorted(r["length"] for r in got if r["doc_id"] == 3) == sorted([4096, 4096, 809] * 2)
    assert [r["length"] for r in got if r["doc_id"] in (1, 2)] == [1, 1]
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_are_kept_on_request(spark):
    df = spark.createDataFrame([(1, "some words here " * 1000)], "doc_id long, text string")
    got = sorted(P.pack(df, capacity=1000, with_ids=True).collect(), key=lambda r: r["piece"])
    ids = np.concatenate([np.array(r["ids"]) for r in got])
    assert ids[-1] == P.END_ID and len(ids) == 3001
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in got)


def test_query_round_trip(spark, data):
    t = WordTokens(default_tokenizer()).tokenizer
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = queries()["op6_packing"](spark, data).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, text in texts.items():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        assert sorted(by[i]) == [(k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert check_layout(got, 4096) <= -(-sum(r["length"] for r in got) // 4096) + 1


def test_an_id_column_called_like_a_result(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "length long, text string")
    got = P.pack(df, id_col="length").collect()
    assert sorted((r["_length"], r["length"]) for r in got) == [(1, 3), (2, 1)]
