"""BPE by backtracking: longest matches, checked pair by pair, give the exact merges in linear time.

A token sequence is what the merge rules make of a word exactly if every neighbouring pair of tokens
is compatible: no merge across their border comes before the merges that build them. So a word is
encoded from left to right with the longest token that starts at each place (all of them from one pass
of an Aho-Corasick automaton); a token that is incompatible with its left neighbour, or ends at a place
from which nothing can go on, gives way to its longest proper prefix, and if there is none, the left
neighbour is taken back. No place is given up twice, which keeps the work linear. Decoding copies bytes
out of one table by offset.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import blocks, col

#: Words a Python worker keeps encoded and pairs it keeps checked; beyond, they start again, which costs time only.
KEEP = 600_000
#: Longer words are encoded each time: they seldom repeat.
KEEP_CHARS = 128
#: Characters of a long text and ids that are handled at once.
SLICE = 1 << 20

_BLANK = re.compile(r"[ \t\n\r\f\v]")
_BLANKS = re.compile(r"[ \t\n\r\f\v]+")
_SEPARATORS = re.compile(r"[\x1c-\x1f]")  # blanks for str.split, not for the tokenizer
_END = "\n"  # stands for the end-of-word suffix; the byte alphabet has no control characters


class PairTable:
    """Merge rules of a vocabulary file: ranks, the two parts of each token, and which pairs are compatible."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocab.values(), default=-1) + 1
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merged: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            t = vocab[a + b]
            if self.rank[t] >= 0:
                raise ValueError("a token with two merge rules has no single way to be taken apart")
            self.rank[t], self.left[t], self.right[t] = r, vocab[a], vocab[b]
            self.merged[vocab[a], vocab[b]] = t
        self.known: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the texts of ``a`` and ``b``, side by side, are encoded as just these two tokens."""
        got = self.known.get((a, b))
        if got is None:
            if len(self.known) > KEEP:
                self.known.clear()
            got = self.known[a, b] = self._holds(a, b, len(self.rank))
        return got

    def _holds(self, a: int, b: int, before: int) -> bool:
        """No merge across the border of ``a`` and ``b`` has a rank under ``before`` when its turn comes.

        Both tokens are taken apart at the border, the later merge first (of equal ranks the right
        one, as merges run from the left); ``before`` is the merge that has just been undone: a rule
        across the border wins against it if it ranks lower, or equal when it lies to the left.
        """
        rank, merged = self.rank, self.merged
        while True:
            across = merged.get((a, b))
            if across is not None and rank[across] < before:
                return False
            if rank[a] > rank[b]:
                before, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                before, b = rank[b] + 1, self.left[b]
            else:
                return True

    def reachable(self) -> list[bool]:
        """Per token, whether the merge rules make it out of its own text."""
        out = [r < 0 for r in self.rank]
        for t in sorted((t for t, r in enumerate(self.rank) if r >= 0), key=self.rank.__getitem__):
            a, b = self.left[t], self.right[t]
            out[t] = out[a] and out[b] and self._holds(a, b, self.rank[t])
        return out


class Backtracker:
    """Encoder and decoder of a BPE tokenizer with an end-of-word suffix, from its JSON file."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pairs = PairTable(vocab, merges)

        # Texts as the automaton sees them: the suffix is one character that ends a word.
        text = {t: (s.removesuffix(self.suffix) + _END if self.suffix and s.endswith(self.suffix) else s)
                for s, t in vocab.items()}
        usable = self.pairs.reachable()
        find = {s: t for t, s in text.items() if usable[t]}
        self.length = {t: len(s) for s, t in find.items()}
        self.shorter = {t: next((find[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in find), -1)
                        for s, t in find.items()}
        self.automaton = ahocorasick.Automaton()
        for s, t in find.items():
            self.automaton.add_word(s, t)
        self.automaton.make_automaton()

        # Added tokens are cut out of the raw text, the longer one first where two begin alike.
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("only plain added tokens are supported")
        self.added = {s: array("I", [t]).tobytes() for s, t in added.items()}
        names = sorted(added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

        front = Tokenizer.from_file(path)
        self.normalizer, self.splitter = front.normalizer, front.pre_tokenizer

        # Decoding table: the bytes of token t are table[at[t]:at[t + 1]]. Without a decoder in the
        # file, tokens are joined by blanks, so each takes one along; the last one of a text is cut.
        if spec.get("decoder"):
            raise ValueError("only files without a decoder are supported")
        names = {**{t: s for s, t in vocab.items()}, **{t: s for s, t in added.items()}}
        pieces = [(names.get(t, "") + " ").encode() for t in range(max(names, default=-1) + 1)]
        self.table = np.frombuffer(b"".join(pieces), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.words = _Words(self)

    def word(self, word: str) -> list[int]:
        """Ids of one pre-token, given in the byte alphabet."""
        text = word + _END if self.suffix else word
        n, length = len(text), self.length
        longest = [-1] * n
        for end, t in self.automaton.iter(text):  # ends ascend: the last match kept for a start is the longest
            longest[end - length[t] + 1] = t
        tokens: list[int] = []
        open_ = bytearray(b"\1") * (n + 1)  # places from which the rest may still be encoded
        at, t = 0, longest[0] if n else -1
        while at < n:
            last = tokens[-1] if tokens else -1
            while t >= 0 and not (open_[at + length[t]] and (last < 0 or self.pairs.compatible(last, t))):
                t = self.shorter[t]
            if t >= 0:
                tokens.append(t)
                at += length[t]
                t = longest[at] if at < n else -1
            elif last < 0:
                raise ValueError(f"no token sequence gives {word[:40]!r}")
            else:
                open_[at] = 0
                t = tokens.pop()
                at -= length[t]
        return tokens

    def chunk(self, chunk: str) -> bytes:
        """Ids of a text without blanks: added tokens, then normalised pre-tokens of the parts between."""
        out = []
        for k, part in enumerate(self.cut.split(chunk) if self.cut else [chunk]):
            if k % 2:
                out.append(self.added[part])
            elif part:
                norm = self.normalizer.normalize_str(part) if self.normalizer else part
                for w, _ in self.splitter.pre_tokenize_str(norm):
                    out.append(array("I", self.word(w)).tobytes())
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers.

        Blanks are dropped by the tokenizer and nothing reaches across them, so the ids of a text are
        the ids of its blank-free parts in order. A long text is cut at blanks.
        """
        if len(text) <= SLICE:
            return self._slice(text)
        out, at = [], 0
        while at < len(text):
            stop = _BLANK.search(text, min(at + SLICE, len(text)))
            end = stop.start() if stop else len(text)
            out.append(self._slice(text[at:end]))
            at = end
        return b"".join(out)

    def _slice(self, text: str) -> bytes:
        parts = _BLANKS.split(text) if _SEPARATORS.search(text) else text.split()
        return b"".join(map(self.words.__getitem__, parts))

    def pieces(self, ids: np.ndarray):
        """Byte arrays that together are the tokens of ``ids``, each followed by a blank."""
        for a in range(0, len(ids), SLICE // 4):
            t = ids[a:a + SLICE // 4]
            size = self.at[t + 1] - self.at[t]
            place = np.cumsum(size)
            index = np.arange(place[-1]) + np.repeat(self.at[t] - (place - size), size)
            yield self.table[index]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the decoded text."""
        return b"".join(p.tobytes() for p in self.pieces(ids))[:-1]

    def decoded_sha256(self, ids: np.ndarray) -> str:
        h, kept = hashlib.sha256(), b""
        for p in self.pieces(ids):
            h.update(kept)
            kept = p.tobytes()
        h.update(kept[:-1])
        return h.hexdigest()


class _Words(dict):
    """Blank-free parts of texts -> ids."""

    def __init__(self, owner: Backtracker):
        super().__init__()
        self.owner = owner

    def __missing__(self, chunk: str) -> bytes:
        got = self.owner.chunk(chunk)
        if len(chunk) <= KEEP_CHARS:
            if len(self) > KEEP:
                self.clear()
            self[chunk] = got
        return got


@lru_cache(maxsize=2)
def backtracker(path: str) -> Backtracker:
    """One per worker and file; it outlives the task, and with it its words and pairs."""
    return Backtracker(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_texts(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every whole text, without special tokens of a template; nothing is exchanged.

    A null or empty text, or one of blanks alone, has no ids. Rows are taken one by one: repeated rows
    give repeated results, null ids stay null, other columns are not read. A very long text
    is cut at blanks, so its words are never all held at once. An empty table gives an empty table.
    """
    path = tokenizer or default_tokenizer()

    def run(batches):
        enc = backtracker(path)
        for batch, texts in blocks(batches):
            got = [enc.encode(t) for t in texts.to_pylist()]
            flat = np.frombuffer(b"".join(got), "<u4").astype(np.int32)
            off = np.concatenate([[0], np.cumsum([len(g) // 4 for g in got])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(off, flat)], names=["doc_id", "ids"])

    return (docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, ids array<int>"))


def decode_ids(tokens: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null or empty ids give an empty text."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        enc = backtracker(path)
        for b in batches:
            out = [enc.decode(np.asarray(i.values, np.int64)).decode() if i.is_valid and len(i.values) else ""
                   for i in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def bpe_digest(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text: encoded, then decoded from its ids.

    Nulls, empty and long texts, repeated rows and other columns as in :func:`encode_texts`.
    """
    path = tokenizer or default_tokenizer()

    def run(batches):
        enc = backtracker(path)
        for batch, texts in blocks(batches):
            got = [enc.encode(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(g) // 4 for g in got], pa.int64()),
                 pa.array([hashlib.sha256(g).hexdigest() for g in got], pa.string()),
                 pa.array([enc.decoded_sha256(np.frombuffer(g, "<u4").astype(np.int64)) for g in got], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
