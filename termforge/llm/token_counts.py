"""Token counts of a unigram segmentation, by trie-shared dynamic programming.

A text is cut into words at white space.  A word's tokens are the pieces of its
best segmentation under a unigram model.  The distinct words of a run of texts
are walked in the order of their trie: forward scores of a shared prefix are
computed once and kept on a stack, and the count at a word's end is stored as
its terminal count.
"""

from __future__ import annotations

import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textbytes as tb

TOKENIZERS = "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Terminal counts kept from one run of texts to the next, in each worker.
KEPT = 1 << 20


class Vocabulary:
    """Pieces with scores.  A piece's score is minus the log of its rank; a character that is no piece costs one token a byte."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.byte_score = min(pieces.values(), default=0.0) - 1.0

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        odd = {i for i in range(n) if model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)}
        return cls({model.id_to_piece(i): -math.log(i + 1.0) for i in range(n) if i not in odd})

    def count(self, words: list[str]) -> list[int]:
        """Token counts of words in ascending order, each with MARK before it."""
        pieces, longest, byte_score = self.pieces, self.longest, self.byte_score
        out = []
        scores, tokens = [0.0], [0]
        last = ""
        for word in words:
            shared = 0
            top = min(len(last), len(word))
            while shared < top and last[shared] == word[shared]:
                shared += 1
            del scores[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                char = word[end - 1]
                if char in pieces:
                    best, count = -math.inf, 0
                else:
                    width = len(char.encode("utf-8", "surrogatepass"))
                    best, count = scores[end - 1] + width * byte_score, tokens[end - 1] + width
                for start in range(max(0, end - longest), end):
                    piece = pieces.get(word[start:end])
                    if piece is not None:
                        score = scores[start] + piece
                        if score > best:
                            best, count = score, tokens[start] + 1
                scores.append(best)
                tokens.append(count)
            out.append(tokens[len(word)])
            last = word
        return out


class _Counter:
    """Terminal counts by word hash, kept while they are few."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = tb.word_hashes(data, starts, ends)
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        own = np.zeros(len(distinct), np.int32)
        known = np.zeros(len(distinct), bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
            known = self.keys[at] == distinct
            own[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            words = [MARK + data[s:e].tobytes().decode("utf-8", "surrogateescape") for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            order = sorted(range(len(words)), key=words.__getitem__)
            own[new[order]] = self.vocabulary.count([words[i] for i in order])
            keys = np.concatenate([self.keys, distinct[new]]) if len(self.keys) + len(new) <= KEPT else distinct[new]
            counts = np.concatenate([self.counts, own[new]]) if len(keys) > len(new) else own[new]
            order = np.argsort(keys)
            self.keys, self.counts = keys[order], counts[order]
        return own[back]


def count_tokens(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_bytes) of every row.

    ``vocabulary`` is the path of a piece model on every executor.  Words are
    runs without ASCII white space.  Null and empty texts have no tokens; rows
    that repeat are counted alike; an empty table gives no rows; other columns
    are ignored.
    """
    path = vocabulary or os.path.join(TOKENIZERS, MODEL)

    def run(batches):
        counter = _Counter(Vocabulary.load(path))
        for batch in batches:
            data, offsets = tb.string_bytes(batch.column(1))
            n = batch.num_rows
            words, tokens = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for a, b in tb.row_chunks(offsets):
                part = data[offsets[a] : offsets[b]]
                starts, ends, first = tb.word_bounds(part, offsets[a : b + 1] - offsets[a], tb.NONSPACE)
                words[a:b] = np.diff(first)
                if len(starts):
                    tokens[a:b] = np.diff(np.concatenate([[0], np.cumsum(counter(part, starts, ends), dtype=np.int64)])[first])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(tokens), pa.array(np.diff(offsets))], names=["doc_id", "n_words", "n_tokens", "n_bytes"])

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, n_bytes long")
