import glob
import math
import zlib

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import queries
from tessera.llm.token_counts import TrieCounter, count_tokens, default_pieces, piece_scores
from tessera.llm.token_output import WordEncoder, default_tokenizer, read_tokens, token_digest, write_tokens

PLAIN = Tokenizer.from_file(default_tokenizer())
ENCODER = WordEncoder(default_tokenizer())


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=800, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="aB'sé ×\n\t  .,!9<|>日😀", max_size=40),
                 st.lists(st.sampled_from(["don't", "I'll", " ", "  ", "\n", "word,", "Été", "<|endoftext|>", "x9", "--"]),
                          max_size=12).map(" ".join)))
def test_words_encode_like_whole_texts(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(ENCODER(text), "<u4").tolist() == ids_of(text)


def digest(docs):
    at, out = 0, []
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = np.array([*ids_of(t), 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.QUERIES["op10_token_parquet"](spark, sf).collect()
    assert sorted(map(tuple, rows)) == sorted(digest(docs))


def test_odd_rows(odd_docs, no_docs):
    rows = list(map(tuple, token_digest(odd_docs).collect()))
    want = digest([(r.doc_id, r.text) for r in odd_docs.collect()])
    key = lambda r: (r[0] is not None, r)
    assert sorted(rows, key=key) == sorted(want, key=key)
    assert token_digest(no_docs).collect() == []


def test_files_have_the_layout_and_selective_reads(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = write_tokens(docs, str(tmp_path / "t"), layout={"parquet.block.size": "65536", "parquet.page.size": "8192"})
    files = sorted(glob.glob(f"{path}/*.parquet"))
    assert sum(pq.ParquetFile(f).num_row_groups for f in files) > len(files)
    last = -1
    for f in files:
        m = pq.ParquetFile(f)
        for i in range(m.num_row_groups):
            for j in range(m.metadata.num_columns):
                c = m.metadata.row_group(i).column(j)
                assert c.has_column_index and c.has_offset_index
                if c.path_in_schema.startswith("ids"):
                    assert "RLE_DICTIONARY" in c.encodings and c.compression == "ZSTD"
                elif c.path_in_schema in ("doc_id", "pos"):
                    assert "DELTA_BINARY_PACKED" in c.encodings
        for i in m.read(["doc_id"])["doc_id"].to_pylist():
            assert i > last
            last = i
    part = read_tokens(spark, path, 20, 29)
    assert sorted(r.doc_id for r in part.select("doc_id").collect()) == list(range(20, 30))
    plan = part.select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan and "GreaterThanOrEqual(doc_id,20)" in plan


def viterbi(word, scores):
    """Segmentation of one word without a trie: (score, tokens) of every prefix."""
    longest, byte = max(map(len, scores)), min(scores.values()) - 10
    best = [(0.0, 0)]
    for d in range(1, len(word) + 1):
        n = len(word[d - 1].encode())
        c = [(best[d - 1][0] + n * byte, -(best[d - 1][1] + n))]
        c += [(best[j][0] + scores[word[j:d]], -(best[j][1] + 1)) for j in range(max(0, d - longest), d)
              if word[j:d] in scores]
        s, k = max(c)
        best.append((s, -k))
    return best[-1][1]


SCORES = piece_scores(default_pieces())


def test_scores_are_a_distribution_over_ids():
    assert len(SCORES) > 30_000 and sum(math.exp(s) for s in SCORES.values()) <= 1


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text(alphabet="theandßé日😀", min_size=1, max_size=9), min_size=1, max_size=8))
def test_trie_counts_equal_plain_segmentation(words):
    c = TrieCounter(SCORES)
    raw = [w.encode() for w in words]
    assert c([raw]) == [sum(viterbi("▁" + w, SCORES) for w in words)]


def test_token_count_query(spark, sf):
    memo = {}
    for r, d in zip(sorted(queries.QUERIES["op9_trie_token_counts"](spark, sf).collect()),
                    sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())):
        words = d.text.encode().split()
        for w in words:
            if w not in memo:
                memo[w] = viterbi("▁" + w.decode(), SCORES)
        assert tuple(r) == (d.doc_id, len(words), len(d.text.encode()), sum(memo[w] for w in words))


def test_token_counts_of_odd_rows(odd_docs, no_docs):
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in count_tokens(odd_docs).collect() if r.doc_id in (3, 4, 5, 7)}
    word = viterbi("▁word", SCORES)
    assert got == {3: (0, 0), 4: (0, 0), 5: (0, 0), 7: (30_000, 30_000 * word)}
    assert count_tokens(odd_docs).count() == odd_docs.count() and count_tokens(no_docs).collect() == []
