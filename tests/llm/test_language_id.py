import numpy as np
import pytest
from pyspark.sql import functions as F

from seatracks.llm import language_id as L
from seatracks.llm.queries import queries


def brute_forward(model, word, k):
    text = L.START + word
    ids = {p: i for i, p in enumerate(model.pieces)}
    alpha = [1.0] + [0.0] * len(text)
    for t in range(1, len(text) + 1):
        for s in range(t):
            piece = text[s:t]
            if piece in ids:
                alpha[t] += alpha[s] * model.prob[ids[piece], k]
            elif t - s == 1:
                alpha[t] += alpha[s] * model.prob[-1, k] * L.UNKNOWN_SHARE
    return np.log(alpha[-1])


@pytest.fixture(scope="module")
def toy():
    pieces = [L.START, L.START + "a", "a", "b", "ab", "ba", L.START + "ab", "bab"]
    rng = np.random.default_rng(0)
    prob = rng.random((len(pieces) + 1, 2))
    return L.PieceModel(pieces, ["x", "y"], prob / prob.sum(axis=0))


def test_forward_sums_all_segmentations(toy):
    words = ["a", "ab", "abab", "babab", "q", "aqb", "abbaabba"]
    got = toy.forward(words)
    for i, w in enumerate(words):
        for k in range(2):
            assert got[i, k] == pytest.approx(brute_forward(toy, w, k))


def test_long_words_are_summed_whole(toy, monkeypatch):
    words = ["ab" * 100, "a", "abbab" * 40 + "q", "ba" * 100]
    want = [[brute_forward(toy, w, k) for k in range(2)] for w in words]
    assert toy.forward(words) == pytest.approx(np.array(want))
    n = np.array([3, 1, 2, 1])
    counts = toy.expected_counts(words, n, 0)
    length = np.array([len(p) for p in toy.pieces] + [1])
    assert (counts * length).sum() == pytest.approx((n * [len(w) + 1 for w in words]).sum())
    monkeypatch.setattr(L, "BLOCK", 64)  # blocks of a few positions
    assert toy.forward(words) == pytest.approx(np.array(want)) and toy.expected_counts(words, n, 0) == pytest.approx(counts)
    far = toy.forward(["ab" * 5000])  # no underflow
    assert np.isfinite(far).all() and (far < -1000).all()


def brute_counts(model, word, k):
    """Expected pieces of a word by listing its segmentations."""
    ids, text, out, total = {p: i for i, p in enumerate(model.pieces)}, L.START + word, np.zeros(len(model.pieces) + 1), 0.0

    def walk(at, own, p):
        nonlocal total
        if at == len(text):
            total += p
            for i in own:
                out[i] += p
        for end in range(at + 1, len(text) + 1):
            i = ids.get(text[at:end], len(model.pieces) if end == at + 1 else None)
            if i is not None:
                walk(end, [*own, i], p * model.prob[i, k] * (L.UNKNOWN_SHARE if i == len(model.pieces) else 1))

    walk(0, [], 1.0)
    return out / total


def test_expected_counts_match_a_list_of_segmentations(toy):
    words, n = ["ab", "abab", "babab", "aqb"], np.array([2, 3, 1, 5])
    assert toy.expected_counts(words, n, 1) == pytest.approx(sum(c * brute_counts(toy, w, 1) for w, c in zip(words, n)))


def test_expected_counts_add_up(toy):
    got = toy.expected_counts(["ab", "abab"], np.array([2, 3]), 0)
    length = np.array([len(p) for p in toy.pieces] + [1])
    assert (got * length).sum() == pytest.approx(2 * 3 + 3 * 5)  # every character of every word lies in one piece


def test_a_language_of_copies_is_learnt_and_copies_count_once(spark):
    rows = [("der hund und die katze", "de"), ("the dog and the cat", "en")]
    once = L.fit(spark.createDataFrame(rows, "text string, lang string"), docs_per_lang=1)
    copies = L.fit(spark.createDataFrame(rows * 200, "text string, lang string"), docs_per_lang=1)
    assert all(len(set(copies.prob[:, k])) > 1 for k in range(2)) and np.array_equal(once.prob, copies.prob)


def test_odd_rows(spark):
    rows = [("der hund und die katze", "de"), ("the dog and the cat", "en")] * 20
    train = spark.createDataFrame(rows + [(None, "en"), ("x", None)], "text string, lang string")
    model = L.fit(train)
    assert model.langs == ["de", "en"]
    texts = [(1, None), (2, ""), (3, "123 !?"), (4, "the dog"), (5, "die katze"), (6, "the cat " * 50_000), (4, "the dog"), (7, "ÄÖ 中文"), (None, "und"), (8, "\u0301\u0302 \u0301"), (9, "the" * 300)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("lang", F.lit("zz"))
    got = L.predict(df, model).collect()
    assert len(got) == len(texts)
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert by[1] == by[2] == by[3] == by[8] == ("und", 0.0)
    clash = L.predict(df.withColumn("lang_pred", F.lit(1)), model, ("doc_id", "lang_pred", "score"))
    assert clash.columns == ["doc_id", "lang_pred", "score"] and {r["doc_id"]: (r["lang_pred"], r["score"]) for r in clash.collect()} == by
    assert by[4][0] == "en" and by[5][0] == "de" and by[6] == ("en", 1.0) and by[None][0] == "de"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_nothing_learnt(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = L.fit(empty)
    one = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert L.predict(one, model).first()["lang_pred"] == "und"
    assert L.predict(empty, model).count() == 0


def test_held_out_accuracy(spark, data):
    truth = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    got = queries()["op2_language_id"](spark, data).join(truth, "doc_id").where("held_out AND lang_pred <> 'und'").toPandas()
    assert len(got) > 20 and (got.lang == got.lang_pred).mean() > 0.97


def test_query_matches_brute_force(spark, data):
    """The fit on a few texts and the score of each text, by the plain forward algorithm over each word."""
    import re

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    from seatracks.llm.queries import held_out

    model = L.fit(docs.where(~held_out(4, 2)))
    rows = docs.collect()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries()["op2_language_id"](spark, data).collect()}
    ids, width, cache = {p: i for i, p in enumerate(model.pieces)}, max(map(len, model.pieces)), {}

    def log_p(word):
        if word not in cache:
            text = L.START + word
            alpha = np.zeros((len(text) + 1, len(model.langs)))
            alpha[0] = 1.0
            for t in range(1, len(text) + 1):
                for s in range(max(0, t - width), t):
                    i = ids.get(text[s:t])
                    if i is not None:
                        alpha[t] += alpha[s] * model.prob[i]
                    elif t - s == 1:
                        alpha[t] += alpha[s] * model.prob[-1] * L.UNKNOWN_SHARE
            cache[word] = np.log(alpha[-1])
        return cache[word]

    assert len(got) == len(rows)
    for r in rows[::5]:
        words = re.findall(r"[^\W\d_]+", (r["text"] or "").lower())
        total = sum((log_p(w) for w in words), np.zeros(len(model.langs)))
        want = ("und", 0.0) if not words else (model.langs[int(total.argmax())], 1.0 / np.exp(total - total.max()).sum())
        assert got[r["doc_id"]][0] == want[0] and got[r["doc_id"]][1] == pytest.approx(want[1], abs=1e-6)
