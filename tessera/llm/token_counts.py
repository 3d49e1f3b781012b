"""Trie-shared dynamic programming: unigram token counts of words, scored once per shared prefix.

The distinct new pre-tokens of a block of documents form a trie, walked depth-first in sorted
order with only the current path stored: the forward score of a prefix (the best segmentation
into pieces, as in unigram tokenization) is computed when the walk first reaches its node and
shared by every pre-token below. Terminal nodes store token counts, and a document's count is
the sum over its words, so no word ever leaves the task that read it.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import blocks, col

#: Words whose counts a Python worker keeps; beyond it the table starts again, which costs time only.
CACHE_WORDS = 600_000
MARK = "▁"


def piece_scores(path: str) -> dict[str, float]:
    """Log-probability of each ordinary piece of a sentencepiece file: Zipf's law over the ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    norm = math.log(sum(1.0 / (i + 1) for i in range(n)))
    return {sp.id_to_piece(i): -math.log(i + 1) - norm for i in range(n)
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}


class TrieCounter:
    """Token counts of words under a unigram model.

    A character without a piece costs its UTF-8 bytes, each a token with a score below every
    piece. Of equally good segmentations the one with fewer tokens counts.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - 10.0
        self.counts: dict[bytes, int] = {}

    def fill(self, words: set[bytes]) -> None:
        """Count ``words``: a depth-first walk of their trie; ``best[d]``, ``used[d]`` hold the path's forward scores."""
        scores, longest = self.scores, self.longest
        path, best, used = "", [0.0], [0]
        for raw in sorted(words):
            word = MARK + raw.decode("utf-8", "replace")
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del best[shared + 1:], used[shared + 1:]
            for d in range(shared + 1, len(word) + 1):
                size = len(word[d - 1].encode())
                top, n = best[d - 1] + size * self.byte, used[d - 1] + size
                for j in range(max(0, d - longest), d):
                    s = scores.get(word[j:d])
                    if s is not None:
                        v = best[j] + s
                        if v > top or (v == top and used[j] + 1 < n):
                            top, n = v, used[j] + 1
                best.append(top)
                used.append(n)
            path = word
            self.counts[raw] = used[-1]

    def __call__(self, texts: list[list[bytes]]) -> list[int]:
        new = {w for t in texts for w in t if w not in self.counts}
        if len(self.counts) + len(new) > CACHE_WORDS:
            self.counts.clear()
            new = {w for t in texts for w in t}
        self.fill(new)
        get = self.counts.__getitem__
        return [sum(map(get, t)) for t in texts]


@lru_cache(maxsize=2)
def counter(path: str) -> TrieCounter:
    return TrieCounter(piece_scores(path))


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(docs: DataFrame, pieces: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_bytes, n_tokens) of every whole text, one row per input row.

    Words are runs without the six ASCII blanks, each with the word mark in front. Null, empty
    and blank texts have 0 words and tokens (n_bytes of the text as it is, null: 0); null ids and
    repeated rows keep their rows; other columns are not read. Map-only: nothing is exchanged.
    """
    path = pieces or default_pieces()

    def run(batches):
        count = counter(path)
        for batch, texts in blocks(batches):
            raw = [t.encode("utf-8") for t in texts.to_pylist()]
            words = [t.split() for t in raw]  # bytes.split cuts at exactly the six ASCII blanks
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array([len(w) for w in words], np.int64)),
                 pa.array(np.array([len(t) for t in raw], np.int64)), pa.array(np.array(count(words), np.int64))],
                names=["doc_id", "n_words", "n_bytes", "n_tokens"])

    return (docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, n_words long, n_bytes long, n_tokens long"))
