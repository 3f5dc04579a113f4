"""Token ids of many texts at once from a public BPE tokenizer that splits at white space.

Each distinct word of a block of texts is encoded once and the texts' ids are put together from the
words'. That gives the ids of the whole texts, since the tokenizer drops white space and no token
or normalisation step reaches across it. Words can be remembered from block to block: what is
remembered saves work, never changes an id, and is forgotten when it holds too many characters.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import split_words


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokens:
    def __init__(self, path: str, remember: int = 0):
        """``remember``: up to so many characters of words are kept from block to block (some 20 bytes each)."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.closing = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)  # ids that end a word
        for token, i in self.tokenizer.get_vocab().items():
            self.closing[i] = token.endswith("</w>")
        self.remember = remember
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.ids = np.zeros(0, dtype=np.uint32)
        self.starts = self.counts = np.zeros(0, dtype=np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them the own ones of each of the distinct ``words`` start and how many there are."""
        known = self.known
        at = np.fromiter((known.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [words[i] for i in new]
            ids, starts, counts = self._encoded(fresh)
            at[new] = np.arange(len(known), len(known) + len(new))
            known.update(zip(fresh, at[new].tolist()))
            self.held += sum(map(len, fresh))
            self.starts, self.counts = np.concatenate([self.starts, starts + len(self.ids)]), np.concatenate([self.counts, counts])
            self.ids = np.concatenate([self.ids, ids])
        got = self.ids, self.starts[at], self.counts[at]
        if self.held > self.remember:
            self._forget()
        return got

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``of_words``, with nothing remembered.

        Words of letters only are encoded many at a time and told apart by the ids that end a word.
        """
        starts, counts = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        letters = np.fromiter((w.isalpha() for w in words), dtype=bool, count=len(words))
        flat, size, single = [], 0, [np.flatnonzero(~letters)]
        runs = [own for own in np.array_split(np.flatnonzero(letters), -(-int(letters.sum()) // 256)) if len(own)] if letters.any() else []
        for own, got in zip(runs, self._encode([" ".join(words[i] for i in own) for own in runs])):
            ids = np.array(got, dtype=np.uint32)
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) != len(own) or ends[-1] != len(ids):
                single.append(own)  # a word in the run falls apart when it is lower-cased
                continue
            starts[own], counts[own] = size + np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)
            flat.append(ids)
            size += len(ids)
        rest = np.concatenate(single)
        got = self._encode([words[i] for i in rest])
        counts[rest] = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        starts[rest] = size + np.cumsum(counts[rest]) - counts[rest]
        flat.append(np.fromiter((i for ids in got for i in ids), dtype=np.uint32, count=int(counts[rest].sum())))
        return np.concatenate(flat), starts, counts

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offset of each text (one more at the end)."""
        texts = pc.fill_null(texts, "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # a special token's string keeps its case
            # The tokenizer lower-cases, and always splits between a letter and these signs.
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([.,!?])", r"\1 \2")
        codes, words, offsets = split_words(texts)
        flat, starts, counts = self.of_words(words.to_pylist())
        lengths = counts[codes] if len(codes) else np.zeros(0, dtype=np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat((starts[codes] if len(codes) else lengths) - (ends - lengths), lengths)
        return flat[at], np.concatenate([[0], ends])[offsets]
