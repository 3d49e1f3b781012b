"""Backtracking BPE against the tokenizers library, and the pair table against plain merging."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import backtrack_bpe as bp

PIECES = ["ab", "a", "e", "th", "ing", " ", "  ", "\n", "\x1c", "\x1f", "\x85", "\xa0", "　", "​", "'s", "'", "'LL", "0", "12",
          "é", "é", "İ", "Σ", "ς", "ß", "日本", "😀", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "</w>", "!!", "Ġ",
          "\x00", "\x0b", "ﬁ", "ǅ", "가", "가", "१", "²", "_", "﻿", "\t"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bp.default_tokenizer())


@pytest.fixture(scope="module")
def own():
    return bp.Backtracker(bp.default_tokenizer())


def same(own, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    got = np.frombuffer(own.encode(text), "<u4").astype(np.int64)
    assert got.tolist() == ids, text[:80]
    want = library.decode(ids, skip_special_tokens=False).encode()
    assert own.decode(got) == want
    assert own.decoded_sha256(got) == hashlib.sha256(want).hexdigest()


def test_random_texts(own, library):
    rnd = random.Random(3)
    for _ in range(4000):
        same(own, library, "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 12))))
    for _ in range(4000):
        same(own, library, "".join(rnd.choice("etaoinshrdlucmfwyp") for _ in range(rnd.randint(1, 25))))
    for _ in range(1000):
        same(own, library, "".join(chr(rnd.choice([rnd.randint(0, 0x300), rnd.randint(0x300, 0xD7FF), rnd.randint(0x10000, 0x10FFFF)]))
                                   for _ in range(8)))


def test_every_blank_and_separator(own, library):
    for c in [*range(0x300), *range(0x1680, 0x1690), *range(0x2000, 0x2070), 0x3000, 0xFEFF]:
        same(own, library, f"a{chr(c)}B {chr(c)}")


def test_long_words_and_long_texts(own, library, monkeypatch):
    for text in ("x" * 50_000, "ab" * 20_000, "ha" * 9_000 + " " + "!" * 9_000):
        same(own, library, text)
    monkeypatch.setattr(bp, "SLICE", 64)  # slices of the text and of its ids
    own.words.clear()
    same(own, library, "several words, cut at blanks\nand 'nowhere' else " * 40 + "y" * 300)


def test_caches_start_again(own, library, monkeypatch):
    monkeypatch.setattr(bp, "KEEP", 5)
    same(own, library, "one two three four five six seven eight nine ten eleven twelve " * 3)


def test_word_by_plain_merging():
    """A small rule set with overlapping and repeated merges, against merging by rank step by step."""
    merges = [("a", "b"), ("b", "a"), ("a", "a"), ("ab", "a"), ("aa", "b"), ("ba", "ba"), ("aa", "aa")]
    vocab = {s: i for i, s in enumerate(["a", "b", *dict.fromkeys(x + y for x, y in merges)])}
    # "aab" and "aba" are made by rules that may lose to earlier ones: such tokens are not used.
    pairs = bp.PairTable(vocab, merges)
    usable = pairs.reachable()

    def merged(word):
        parts = list(word)
        while True:
            ranks = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
            if not ranks:
                return parts
            _, i = min(ranks)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    for s, t in vocab.items():
        assert usable[t] == (merged(s) == [s])
    for a in vocab:
        for b in vocab:
            if usable[vocab[a]] and usable[vocab[b]]:
                assert pairs.compatible(vocab[a], vocab[b]) == (merged(a + b) == [a, b]), (a, b)


def test_two_rules_for_a_token_are_refused():
    with pytest.raises(ValueError):
        bp.PairTable({"a": 0, "aa": 1, "aaa": 2}, [("a", "a"), ("a", "aa"), ("aa", "a")])


def test_digest_and_round_trip(odd_docs, no_docs, library):
    rows = odd_docs.select("doc_id", "text").collect()
    want = []
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in bp.bpe_digest(odd_docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    tokens = bp.encode_texts(odd_docs)
    texts = {r.doc_id: r.text for r in bp.decode_ids(tokens).collect()}
    assert texts[10] == "one</w>" and texts[4] == "" and texts[3] == ""
    assert bp.bpe_digest(no_docs).count() == 0 and bp.encode_texts(no_docs).count() == 0


def test_sample_table_equals_library(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in bp.bpe_digest(docs).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
