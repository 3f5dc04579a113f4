import random

import pytest
from pyspark.sql import functions as F

from seatracks.llm import toxicity as X
from seatracks.llm.queries import queries


def sentences(seed=0, n=300):
    """Toxic sentences often name one group; clean ones seldom do."""
    rng = random.Random(seed)
    filler = "river table garden winter music paper window market letter summer".split()
    rows = []
    for i in range(n):
        words = [rng.choice(filler) for _ in range(12)]
        toxic = i % 3 == 0
        if toxic:
            words.insert(rng.randrange(12), rng.choice(["vilescum", "filthrat"]))
        if rng.random() < (0.9 if toxic else 0.02):
            words.insert(rng.randrange(12), "muslim")
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text").withColumn("label", F.lit("clash")).withColumn("score", F.lit(9)), df.select("doc_id", "toxic")


def test_swaps_cut_the_score_of_neutral_mentions(spark):
    docs, labels = tables(spark, sentences())
    neutral = spark.createDataFrame([(1, "a muslim garden in summer"), (2, "a garden in summer"), (3, "you vilescum"), (4, "filthrat muslim")], "doc_id long, text string")
    scores = {}
    for fairness in (0.0, 3.0):
        model = X.fit(docs, labels, least_z=1.0, fairness=fairness)
        scores[fairness] = {r["doc_id"]: r["score"] for r in X.score(neutral, model).collect()}
    gap = lambda s: s[1] - s[2]
    assert gap(scores[3.0]) < 0.3 * gap(scores[0.0])
    assert scores[3.0][3] > 0.7 and scores[3.0][4] > 0.7 and scores[3.0][1] < 0.5


def test_odd_rows(spark):
    docs, labels = tables(spark, sentences() + [(1000, None, 1), (None, "x", 1)])
    labels = labels.unionByName(spark.createDataFrame([(2, None), (None, 0), (5000, 1)], "doc_id long, toxic int"))
    model = X.fit(docs, labels, least_z=1.0)
    rows = [(1, None), (2, ""), (3, "VILESCUM!"), (4, "w" * 100_000), (5, "garden " * 50_000 + "filthrat"), (3, "VILESCUM!"), (None, "letter")]
    got = X.score(spark.createDataFrame(rows, "doc_id long, text string").withColumn("predicted", F.lit("clash")), model).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert (by[1], by[2], by[3], by[5]) == (0, 0, 1, 1)


@pytest.mark.parametrize("rows", [[], [(1, "only clean", 0)], [(1, "only toxic", 1)]])
def test_too_little_to_learn(spark, rows):
    docs, labels = tables(spark, rows)
    model = X.fit(docs, labels)
    got = X.score(spark.createDataFrame([(1, "anything")], "doc_id long, text string"), model).first()
    assert got["score"] < 0.01 and got["predicted"] == 0


def test_query_covers_all_rows(spark, data):
    got = queries()["op9_toxicity"](spark, data).collect()
    assert len(got) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert {r["held_out"] for r in got} == {True, False}


def test_features_of_long_words(spark):
    """N-grams of whole words, each once, and no word end where a word goes on; against plain Python."""
    words = ["vilescum", "x" * 39 + "yz", "ab" * 100, "ab" * 1500 + "q", "c" * 5000]
    got = {}
    for r in X.features_of(spark.createDataFrame([(w, i, 1) for i, w in enumerate(words)], "word string, toxic int, clean int")).collect():
        got.setdefault(r["toxic"], []).append(r["feature"])
    for i, w in enumerate(words):
        m = f"^{w}$"
        want = {m[k : k + n] for n in X.SIZES for k in range(max(1, len(m) - n + 1))} | ({m} if len(w) <= X.LONGEST_WORD else set())
        assert {f for f in got[i] if len(f) >= 3} == {f for f in want if len(f) >= 3}
        assert len([f for f in got[i] if len(f) > 3]) == len({f for f in got[i] if len(f) > 3})


def test_fit_and_score_agree_on_words_of_200_letters(spark):
    rows = [(i, ("qz" * 100 + "toxend" if i % 3 == 0 else "garden river") + " paper", int(i % 3 == 0)) for i in range(60)]
    docs, labels = tables(spark, rows)
    model = X.fit(docs, labels, least_z=1.0)
    got = {r["doc_id"]: r["score"] for r in X.score(docs, model).collect()}
    assert all((got[i] >= 0.7) == bool(t) for i, _, t in rows)
    text, feature = model.table.of_texts(__import__("pyarrow").array([r[1] for r in rows[:2]]))
    names = {model.table.features[f] for t, f in zip(text, feature) if t == 0}
    assert "end$" in names and not any(f.endswith("$") and not "toxend$".endswith(f) for f in names if "q" in f or "z" in f)


def test_repeated_and_contradicting_labels(spark):
    docs, labels = tables(spark, sentences())
    once = X.bounded_labels(labels, "doc_id", "toxic", 1000, 11).collect()
    more = labels.unionByName(labels).unionByName(spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int"))
    got = X.bounded_labels(more, "doc_id", "toxic", 1000, 11).collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r) for r in once if r["doc_id"] not in (0, 1))


def brute_score(model, text):
    """The score by looking up each feature in each marked word of the text."""
    import math
    import re

    words = {f"^{w}$" for w in re.findall(r"[^\W\d_]+", (text or "").lower())}
    logit = model.bias + sum(w for f, w in zip(model.table.features, model.weights) if any(f in m for m in words))
    return 1 / (1 + math.exp(-max(-30, min(30, logit))))


def test_query_on_held_out_rows_and_against_brute_force(spark):
    """On 1,000 documents: scores by brute force, and recall and false positives among rows that taught nothing."""
    data = "/root/testdata/sf0.01"
    if not __import__("os").path.isdir(data):
        pytest.skip("no test tables")
    from seatracks.llm.queries import held_out

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = X.fit(docs, labels.where(~held_out(3, 1)))
    got = {r["doc_id"]: r for r in queries()["op9_toxicity"](spark, data).collect()}
    for r in docs.collect()[::20]:
        assert got[r["doc_id"]]["score"] == pytest.approx(brute_score(model, r["text"]), abs=1e-6)
    truth = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in labels.collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"] and r["toxic"] is not None]
    toxic, clean = [p for p, t in truth if t], [p for p, t in truth if not t]
    assert len(toxic) >= 5 and len(clean) >= 50
    assert sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_rows_that_share_a_labelled_id_do_not_swell_the_sample(spark, monkeypatch):
    sizes = []
    real = X.written
    monkeypatch.setattr(X, "written", lambda df, name="step": sizes.append((name, real(df, name))) or sizes[-1][1])
    docs = spark.createDataFrame([(i % 4, f"text {i} {'vile' if i % 2 else 'mild'}") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    X.fit(docs, labels, rows_per_label=2)
    assert dict(sizes)["sample"].count() <= 4


def test_score_of_an_empty_table(spark):
    model = X.fit(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert X.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
