"""Language identification by segmentation-marginalised unigrams.

For each language the probabilities of the pieces of a fixed public vocabulary are learnt by
expectation maximisation; a word's probability sums over all its segmentations into pieces (forward
algorithm), and a text's is the product over its words. The score is the posterior of the best
language under equal priors.

Words are runs of letters and marks with a letter among them, lower-cased and of any length. A character that is no
piece by itself counts as the unknown piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import StringTable, by_length, free_name, split_words, sum_by_text, text_chunks, written

NOT_LETTERS = r"[^\p{L}\p{M}]+"
START = "▁"
#: Characters (words of one length times positions) whose pieces are looked up at a time.
BLOCK = 1 << 20
#: Positions after which the forward sums are scaled, so that long words do not underflow.
RESCALE = 8
#: Probability of one particular unknown character given the unknown piece.
UNKNOWN_SHARE = 1e-3
#: Pseudo-count of each piece in each language.
SMOOTHING = 0.05


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> list[str]:
    """Pieces of letters and marks, with or without the word start sign, in the file's order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        body = piece.removeprefix(START)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and (body.isalpha() or piece == START) and body == body.lower():
            out.append(piece)
    return out


def letter_words(texts: pa.Array):
    """Codes, distinct words and offsets of the lower-cased letter runs of each text; runs of marks alone are no words."""
    codes, words, offsets = split_words(pc.utf8_lower(pc.fill_null(texts, "")), NOT_LETTERS)
    lettered = pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
    if not lettered.all():
        keep = lettered[codes] if len(codes) else np.zeros(0, dtype=bool)
        codes, offsets = codes[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
    return codes, words, offsets


class PieceModel:
    """Piece probabilities of each language: ``prob[piece, language]``, the unknown piece last."""

    def __init__(self, pieces: list[str], langs: list[str], prob: np.ndarray):
        self.pieces, self.langs = pieces, langs
        self.prob = prob
        self._table: StringTable | None = None

    def __getstate__(self):
        return {"pieces": self.pieces, "langs": self.langs, "prob": self.prob, "_table": None}

    @property
    def table(self) -> StringTable:
        if self._table is None:
            self._table = StringTable(self.pieces)
        return self._table

    def _lattice(self, chars: np.ndarray):
        """(width, piece of each window of that width or -1); a single character that is no piece is the unknown piece."""
        return [(width, np.where(ids < 0, len(self.pieces), ids) if width == 1 else ids) for width, ids in self.table.matches(chars)]

    def _groups(self, words: list[str]):
        """(positions in ``words``, marked words as code points) of words of one length, about BLOCK characters together."""
        for own, chars in by_length(words):
            rows = max(1, BLOCK // (chars.shape[1] + 1))
            for i in range(0, len(own), rows):
                part = chars[i : i + rows]
                yield own[i : i + rows], np.concatenate([np.full((len(part), 1), ord(START), dtype=np.uint32), part], axis=1)

    def forward(self, words: list[str]) -> np.ndarray:
        """log P(word | language), summed over all segmentations, for each word and language."""
        prob = self.prob.copy()
        prob[-1] *= UNKNOWN_SHARE
        out = np.zeros((len(words), len(self.langs)))
        for own, chars in self._groups(words):
            (rows, n), longest = chars.shape, self.table.width
            # Sums of the prefixes that end at the last ``longest`` positions, newest last, over exp(scale).
            window, scale = [np.ones((rows, len(self.langs)))], np.zeros((rows, len(self.langs)))
            step = max(1, BLOCK // rows)
            for at in range(0, n, step):
                low = max(0, at + 1 - longest)
                lattice = self._lattice(chars[:, low : at + step])
                for t in range(at + 1, min(at + step, n) + 1):
                    total = np.zeros((rows, len(self.langs)))
                    for width, ids in lattice:
                        if width <= t:
                            piece, before = ids[:, t - width - low], window[-width]
                            hit = np.flatnonzero(piece >= 0)
                            if len(hit) == rows:
                                total += before * prob[piece]
                            elif len(hit):
                                total[hit] += before[hit] * prob[piece[hit]]
                    window = [*window[1 - longest :], total] if longest > 1 else [total]
                    if t % RESCALE == 0:
                        top = np.maximum(np.max(window, axis=0), 1e-300)
                        window, scale = [x / top for x in window], scale + np.log(top)
            out[own] = np.log(np.maximum(window[-1], 1e-300)) + scale
        return out

    def expected_counts(self, words: list[str], counts: np.ndarray, lang: int) -> np.ndarray:
        """Expected number of each piece over all segmentations of the counted words of one language."""
        prob = self.prob[:, lang].copy()
        prob[-1] *= UNKNOWN_SHARE
        log_prob = np.append(np.log(prob), -np.inf)  # -1: no piece
        out = np.zeros(len(self.pieces) + 1)
        for own, chars in self._groups(words):
            (rows, n), longest = chars.shape, self.table.width
            step, weight = max(1, BLOCK // rows), counts[own].astype(float)
            alpha = np.full((n + 1, rows), -np.inf)  # logarithms of the sums over prefixes
            alpha[0] = 0.0
            for at in range(0, n, step):
                low = max(0, at + 1 - longest)
                lattice = self._lattice(chars[:, low : at + step])
                for t in range(at + 1, min(at + step, n) + 1):
                    alpha[t] = _log_sum([alpha[t - width] + log_prob[ids[:, t - width - low]] for width, ids in lattice if width <= t])
            beta = [np.zeros(rows)]  # of the suffixes from the next ``longest`` positions on, nearest last
            for at in range(step * ((n - 1) // step), -1, -step):
                lattice = self._lattice(chars[:, at : min(n, at + step + longest - 1)])
                for t in range(min(at + step, n) - 1, at - 1, -1):
                    ways = [(ids[:, t - at], log_prob[ids[:, t - at]] + beta[-width]) for width, ids in lattice if t + width <= n]
                    for piece, rest in ways:
                        hit = np.flatnonzero(piece >= 0)
                        out += np.bincount(piece[hit], weights=weight[hit] * np.exp(alpha[t, hit] + rest[hit] - alpha[n, hit]), minlength=len(out))
                    beta = [*beta[1 - longest :], _log_sum([rest for _, rest in ways])] if longest > 1 else [_log_sum([rest for _, rest in ways])]
        return out


def _log_sum(parts: list[np.ndarray]) -> np.ndarray:
    top = np.max(parts, axis=0)
    return top + np.log(np.sum(np.exp(np.array(parts) - top), axis=0))


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", vocabulary: str | None = None, docs_per_lang: int = 1000, rounds: int = 3, seed: int = 42) -> PieceModel:
    """Learn the piece probabilities from rows with a non-null language and text.

    Of each language about ``docs_per_lang`` different texts (a bound on the sample; all, if fewer) are picked
    by their hash, whole texts each; copies count once. What reaches the driver is one number for each piece and language.
    Null texts and languages teach nothing; an empty table gives a model without languages; other columns do not matter.
    """
    pieces = load_pieces(vocabulary or default_vocabulary())
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text", F.lit(seed)))
    per_lang = {r["lang"]: r["n"] for r in rows.select("lang", "hash").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(per_lang)
    prob = np.full((len(pieces) + 1, max(1, len(langs))), 1.0 / (len(pieces) + 1))
    model = PieceModel(pieces, langs, prob)
    if not langs:
        return model
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, docs_per_lang / per_lang[k]))))
    unit = (F.col("hash") % F.lit(1 << 31)) / F.lit(float(1 << 31))
    sample = rows.where(F.abs(unit) < share[F.col("lang")]).dropDuplicates(["lang", "hash"]).select("lang", "text")

    def count_words(batches):
        for batch in batches:
            for part in text_chunks(batch, "text"):
                codes, words, offsets = letter_words(part.column(1))
                of = np.repeat(np.unique(part.column(0).to_pylist(), return_inverse=True)[1], np.diff(offsets))
                names = np.unique(part.column(0).to_pylist())
                n = np.bincount(of * len(words) + codes, minlength=0)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[at // max(1, len(words))].tolist(), pa.string()), words.take(pa.array(at % max(1, len(words)))).cast(pa.string()), pa.array(n[at])],
                    names=["lang", "word", "n"],
                )

    counted = written(sample.mapInArrow(count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    for _ in range(rounds):

        def expect(batches, model=model):
            for batch in batches:
                lang, words, n = (batch.column(i) for i in range(3))
                for k, name in enumerate(model.langs):
                    own = pc.equal(lang, name)
                    if not pc.any(own).as_py():
                        continue
                    got = model.expected_counts(pc.filter(words, own).to_pylist(), pc.filter(n, own).to_numpy(zero_copy_only=False), k)
                    at = np.flatnonzero(got)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(got[at])], names=["lang", "piece", "n"])

        sums = counted.mapInArrow(expect, "lang bigint, piece bigint, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        n = np.full(prob.shape, SMOOTHING)
        n[sums["piece"].to_numpy(), sums["lang"].to_numpy()] += np.round(sums["n"].to_numpy(), 6)
        model = PieceModel(pieces, langs, n / n.sum(axis=0))
    return model


def predict(df: DataFrame, model: PieceModel, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The ``keep`` columns of each row, lang_pred and score (0 to 1).

    Null texts, texts without a letter and all texts under a model without languages: ``und`` and 0. Words of any length
    and whole texts count; of equally likely languages the first by name is taken; repeated rows get the same each; an
    empty table gives an empty result. Of the kept columns, those with a name in ``names`` give way to the result's.
    """
    keep = [c for c in keep if c not in names]
    hidden = free_name(keep, "text")
    schema = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches):
        langs = np.array([*model.langs, "und"], dtype=object)
        for batch in batches:
            for part in text_chunks(batch, hidden):
                codes, words, offsets = letter_words(part.column(part.num_columns - 1))
                best = np.full(part.num_rows, len(model.langs))
                score = np.zeros(part.num_rows)
                if model.langs:
                    each = model.forward(words.to_pylist())
                    total = np.stack([sum_by_text(each[codes, k], offsets) for k in range(each.shape[1])], axis=1)
                    some = np.flatnonzero(np.diff(offsets) > 0)
                    top = total[some].max(axis=1, initial=-np.inf)
                    best[some] = total[some].argmax(axis=1)
                    score[some] = 1.0 / np.exp(total[some] - top[:, None]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs[best].tolist(), pa.string()), pa.array(score)], names=[*keep, *names])

    return df.select(*keep, F.col(text_col).alias(hidden)).mapInArrow(run, ", ".join([*schema, f"`{names[0]}` string", f"`{names[1]}` double"]))
