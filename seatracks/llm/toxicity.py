"""Toxicity: a counterfactual-regularised linear classifier on word and character n-gram presence.

Features are strings looked up inside ``^word$``: character n-grams of words of any length and whole words of up to
``LONGEST_WORD`` letters that occur significantly more often in toxic rows, and the identity terms. Weights minimise the logistic loss over a
bounded sample of labelled rows, plus a ridge, plus a penalty on the squared differences of the logits of a text
and its counterfactuals: one in which each identity term is swapped for the next of its group, and one in which it
is swapped for a neutral word that is no feature. So a mere mention of a group cannot carry a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import StringTable, by_length, free_name, split_words, text_chunks, written
from .language_id import NOT_LETTERS

# Neutral names of groups, swapped within their line.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "straight", "lesbian", "bisexual", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "hispanic"),
    ("african", "european", "american", "mexican", "chinese", "indian", "arab"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "elderly"),
)
SIZES = (3, 4, 5, 6)
#: Longest word that is a feature as a whole (by default); longer ones have their n-grams as features.
LONGEST_WORD = 40
#: Longest word whose n-grams are listed in one row.
LISTED_WORD = 1000


def identity_swaps(groups=IDENTITY_GROUPS) -> dict[str, str]:
    return {a: b for g in groups for a, b in zip(g, (*g[1:], g[0]))}


def words_of(texts: pa.Array):
    return split_words(pc.utf8_lower(pc.fill_null(texts, "")), NOT_LETTERS)


class FeatureTable:
    """Which features each word holds."""

    def __init__(self, features: list[str]):
        self.features = features
        self._table: StringTable | None = None

    def __getstate__(self):
        return {"features": self.features, "_table": None}

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word, feature) for all features inside ``^word$``; over-long words are looked up in overlapping pieces."""
        if self._table is None:
            self._table = StringTable(self.features)
        text, of = [], []
        for i, w in enumerate(words):
            w = f"^{w}$"
            for at in range(0, max(1, len(w) - self._table.width), LONGEST_WORD):
                text.append(w[at : at + LONGEST_WORD + self._table.width])
                of.append(i)
        rows, found = [], []
        for own, chars in by_length(text):
            for _, ids in self._table.matches(chars):
                r, c = np.nonzero(ids >= 0)
                rows.append(own[r])
                found.append(ids[r, c])
        if not rows:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        pair = np.unique(np.array(of, dtype=np.int64)[np.concatenate(rows)] * len(self.features) + np.concatenate(found))
        return pair // len(self.features), pair % len(self.features)

    def of_texts(self, texts: pa.Array, swaps: dict[str, str] | None = None):
        """(text, feature), each once; with ``swaps`` also the same of both counterfactuals of the texts that have them."""
        codes, words, offsets = words_of(texts)
        words = words.to_pylist()
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        plain = self._pairs(text, codes, words)
        if swaps is None:
            return plain
        swapped, neutral = [swaps.get(w, w) for w in words], ["" if w in swaps else w for w in words]
        named = np.fromiter((w in swaps for w in words), dtype=bool, count=len(words))
        with_term = np.unique(text[named[codes]]) if len(codes) else np.zeros(0, dtype=np.int64)
        mine = np.isin(text, with_term)
        return plain, self._pairs(text[mine], codes[mine], swapped), self._pairs(text[mine], codes[mine], neutral), with_term

    def _pairs(self, text: np.ndarray, codes: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        word, feature = self.of_words(words)
        per = np.bincount(word, minlength=len(words))
        start = np.concatenate([[0], np.cumsum(per)])
        hit = np.flatnonzero(per[codes] > 0) if len(codes) else np.zeros(0, dtype=np.int64)
        n = per[codes[hit]]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[codes[hit]] - (ends - n), n)
        pair = np.unique(np.repeat(text[hit], n) * max(1, len(self.features)) + feature[at])
        return pair // max(1, len(self.features)), pair % max(1, len(self.features))


class Classifier:
    def __init__(self, features: list[str], weights: np.ndarray, bias: float):
        self.table, self.weights, self.bias = FeatureTable(features), weights, bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        text, feature = self.table.of_texts(texts)
        logit = self.bias + np.bincount(text, weights=self.weights[feature], minlength=len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))


def train(n: int, rows: tuple[np.ndarray, np.ndarray], labels: np.ndarray, swapped: list[tuple[np.ndarray, np.ndarray]], n_features: int, ridge: float = 1e-4, fairness: float = 1.0, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent.

    rows: (row, feature) of the labelled rows. swapped: (features, features of the counterfactual) of the rows that have one.
    """
    row, feature = rows
    pair_row, pair_feature, pair_sign = [], [], []
    for i, (a, b) in enumerate(swapped):
        for own, sign in ((a, 1.0), (b, -1.0)):
            pair_row.append(np.full(len(own), i))
            pair_feature.append(own)
            pair_sign.append(np.full(len(own), sign))
    pr, pf, ps = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (pair_row, pair_feature, pair_sign))
    weight = np.where(labels > 0, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    # Rare features get longer steps: the descent runs on weights divided by this scale.
    scale = 1.0 / np.sqrt(np.bincount(feature, weights=weight[row], minlength=n_features) + 1e-3)

    def curved(v: np.ndarray) -> np.ndarray:
        """An upper bound of the loss's Hessian times a direction (features, then the bias)."""
        w = v[:-1] * scale
        z = weight * (np.bincount(row, weights=w[feature], minlength=n) + v[-1])
        out = 0.25 * np.bincount(feature, weights=z[row], minlength=n_features) + ridge * w
        if len(pr):
            gap = np.bincount(pr, weights=ps * w[pf], minlength=len(swapped))
            out += 2 * fairness / max(1, len(swapped)) * np.bincount(pf, weights=ps * gap[pr], minlength=n_features)
        return np.append(out * scale, 0.25 * z.sum())

    v = np.ones(n_features + 1)
    for _ in range(20):
        v = curved(v / np.linalg.norm(v))
    rate = 0.9 / np.linalg.norm(v)
    w, b, t = np.zeros(n_features), 0.0, 1.0
    v, c = w.copy(), b
    for _ in range(steps):
        real = v * scale
        p = 1.0 / (1.0 + np.exp(-np.clip(c + np.bincount(row, weights=real[feature], minlength=n), -30, 30)))
        e = weight * (p - labels)
        gw = np.bincount(feature, weights=e[row], minlength=n_features) + ridge * real
        if len(pr):
            gap = np.bincount(pr, weights=ps * real[pf], minlength=len(swapped))
            gw += 2 * fairness / max(1, len(swapped)) * np.bincount(pf, weights=ps * gap[pr], minlength=n_features)
        nw, nb = v - rate * scale * gw, c - rate * e.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w * scale, float(b)


def _substrings(text: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1)), lambda i: F.substring(text, i, F.lit(n)))


def features_of(words: DataFrame, longest_word: int = LONGEST_WORD) -> DataFrame:
    """(feature, toxic, clean): the features of each of ``words`` (word, toxic, clean), each once."""
    marked = words.withColumn("marked", F.concat(F.lit("^"), "word", F.lit("$")))
    whole = F.when(F.length("word") <= longest_word, F.array("marked")).otherwise(F.array().cast("array<string>"))
    grams = F.concat(whole, *(_substrings(F.col("marked"), n) for n in SIZES))
    listed = marked.where(F.length("word") <= LISTED_WORD).select(F.explode(F.array_distinct(grams)).alias("feature"), "toxic", "clean")
    each = marked.where(F.length("word") > LISTED_WORD).withColumn("of", F.xxhash64("word")).withColumn("at", F.explode(F.sequence(F.lit(1), F.length("marked") - min(SIZES) + 1)))
    each = each.select("of", "toxic", "clean", F.explode(F.array(*(F.substring("marked", F.col("at"), F.lit(n)) for n in SIZES))).alias("feature")).distinct()
    return listed.unionByName(each.select("feature", "toxic", "clean"))


def bounded_labels(labels: DataFrame, id_col: str, label_col: str, rows_per_label: int, seed: int) -> DataFrame:
    """(id_col, label): about ``rows_per_label`` ids of label 0 and of label 1 at most, picked by a hash of the id.

    An id labelled more than once counts once, and not at all if its labels contradict each other.
    """
    rows = labels.select(id_col, F.col(label_col).cast("int").alias("label")).where(F.col(id_col).isNotNull() & F.col("label").isin(0, 1))
    rows = rows.groupBy(id_col).agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two labels
    unit = F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("label") == 1, min(1.0, rows_per_label / max(1, n.get(1, 0)))).otherwise(min(1.0, rows_per_label / max(1, n.get(0, 0))))
    return rows.where(unit < share)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_label: int = 6000, most_features: int = 4000, least_z: float = 3.0, fairness: float = 1.0, ridge: float = 1e-4, groups=IDENTITY_GROUPS, longest_word: int = LONGEST_WORD, seed: int = 11) -> Classifier:
    """Learn from the texts of ``docs`` whose id has a label of 0 or 1 in ``labels``.

    At most about ``rows_per_label`` rows of each label are used, whole texts each; that bounds the broadcast
    labels and the sample. The driver gets at most ``most_features`` strings and the sample's feature numbers. Null
    texts, ids and labels teach nothing; repeated labels of an id count once, contradicting ones not at all; of rows of
    ``docs`` that share a labelled id one teaches, the one whose text has the smallest hash. Words of any length count by their n-grams; one of up
    to ``longest_word`` letters is a feature as a whole too, which bounds the size of the ``most_features`` strings; equally telling features are taken by name;
    other columns do not matter. Without rows of both labels (empty tables) the classifier scores 0.
    """
    few = bounded_labels(labels, id_col, label_col, rows_per_label, seed)
    sample = docs.select(id_col, F.col(text_col).alias("text")).where("text IS NOT NULL").join(F.broadcast(few), id_col)
    sample = sample.groupBy(id_col).agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
    sample = written(sample.select("text", "label"), "sample")

    def count_words(batches):
        for batch in batches:
            for part in text_chunks(batch, "text"):
                codes, words, offsets = words_of(part.column(0))
                label = part.column(1).to_numpy(zero_copy_only=False)
                text = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                pair = np.unique(text * max(1, len(words)) + codes)
                of, word = pair // max(1, len(words)), pair % max(1, len(words))
                toxic = np.bincount(word, weights=label[of], minlength=len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(toxic), pa.array(np.bincount(word, minlength=len(words)) - toxic)], names=["word", "toxic", "clean"])

    words = sample.mapInArrow(count_words, "word string, toxic bigint, clean bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = written(features_of(written(words, "words"), longest_word).groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where("t >= 3 AND length(feature) >= 3"), "features")
    total = counted.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    z = (F.log(t / float((total["t"] or 0) + 1)) - F.log(c / float((total["c"] or 0) + 1))) / F.sqrt(1 / t + 1 / c)
    top = counted.withColumn("z", z).where(F.col("z") >= least_z).orderBy(F.col("z").desc(), "feature").limit(most_features).select("feature").collect()
    swaps = identity_swaps(groups)
    features = list(dict.fromkeys([*(f"^{w}$" for w in swaps), *(r["feature"] for r in top)]))
    table = FeatureTable(features)

    def look_up(batches):
        for batch in batches:
            for part in text_chunks(batch, "text"):
                (row, feature), (row2, feature2), (row3, feature3), with_term = table.of_texts(part.column(0), swaps)
                cut = lambda r, f: [x.astype(np.int32) for x in np.split(f, np.searchsorted(r, np.arange(1, part.num_rows)))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(cut(row, feature), pa.list_(pa.int32())), pa.array(cut(row2, feature2), pa.list_(pa.int32())), pa.array(cut(row3, feature3), pa.list_(pa.int32())), pa.array(np.isin(np.arange(part.num_rows), with_term))],
                    names=["label", "features", "swapped", "neutral", "named"],
                )

    got = sample.mapInArrow(look_up, "label int, features array<int>, swapped array<int>, neutral array<int>, named boolean").toPandas()  # bounded by the sample
    if not {0, 1} <= set(got["label"]):
        return Classifier(features, np.zeros(len(features)), -30.0)
    n = len(got)
    row = np.repeat(np.arange(n), got["features"].map(len))
    feature = np.concatenate([np.asarray(x, dtype=np.int64) for x in got["features"]])
    named = got[got["named"]]
    pairs = [(np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)) for other in ("swapped", "neutral") for a, b in zip(named["features"], named[other])]
    weights, bias = train(n, (row, feature), got["label"].to_numpy().astype(float), pairs, len(features), ridge, fairness)
    return Classifier(features, np.round(weights, 9), round(bias, 9))


def score(df: DataFrame, model: Classifier, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", limit: float = 0.7) -> DataFrame:
    """The ``keep`` columns of each row, score (0 to 1) and predicted (1 from ``limit`` on); null and empty texts get the score of no feature.

    Whole texts count, however long; repeated rows get the same score each; an empty table gives an empty result. Kept
    columns called score or predicted give way to the result's.
    """
    keep = [c for c in keep if c not in ("score", "predicted")]
    hidden = free_name(keep, "text")
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "score double", "predicted int"])

    def run(batches):
        for batch in batches:
            for part in text_chunks(batch, hidden):
                p = model.scores(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(p), pa.array((p >= limit).astype(np.int32))], names=[*keep, "score", "predicted"])

    return df.select(*keep, F.col(text_col).alias(hidden)).mapInArrow(run, schema)
