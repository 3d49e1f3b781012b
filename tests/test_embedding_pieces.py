"""The trigram embedder counts in pieces: memory of one piece, and the same vectors wherever texts are cut."""

import hashlib
import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import embedding as em


def expected(text):
    out = [0.0] * 64
    p = " " + " ".join(text.lower().split()) + " " if text is not None else ""
    seen = {}
    for i in range(len(p) - 2):
        g = p[i:i + 3]
        if g not in seen:
            seen[g] = int(hashlib.md5(g.encode()).hexdigest()[:2], 16) % 64
        out[seen[g]] += 1
    return out


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeäß漢") for _ in range(rng.randint(1, 6))) for _ in range(n))


def test_a_batch_of_long_texts_takes_the_memory_of_a_piece():
    rng = random.Random(3)
    texts = [words(rng, 400) for _ in range(2000)]
    counts = em.DEFAULT_EMBEDDER._counter(64, 1 << 20)
    tracemalloc.start()
    m = counts(iter(texts), len(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts)) > 3_000_000
    assert peak < 60e6  # the whole batch at once took some 100 bytes a character
    assert m[7].tolist() == expected(texts[7])


def test_cuts_change_no_vector(monkeypatch):
    rng = random.Random(4)
    texts = [words(rng, rng.randint(0, 40)) for _ in range(60)] + [None, "", "  ", "a", "ab", words(rng, 300)]
    for chars, n in ((1, 4096), (7, 4096), (64, 3), (1 << 18, 5)):
        monkeypatch.setattr(em, "PIECE_CHARS", chars)
        monkeypatch.setattr(em, "PIECE_TEXTS", n)
        got = em.DEFAULT_EMBEDDER._counter(64, 50)(texts, len(texts))
        np.testing.assert_array_equal(got, [expected(t) for t in texts])


def test_columns_of_long_texts_and_long_lists(spark):
    rng = random.Random(5)
    long_text, many = words(rng, 90_000), [words(rng, 2) for _ in range(9000)]
    assert len(long_text) > em.PIECE_CHARS and len(many) > 2 * em.PIECE_TEXTS
    rows = [(0, long_text, many), (1, None, None), (2, "", []), (3, "x y", ["one", None, "two"])]
    rows += [(i, words(rng, 3), [words(rng, 2)] * (i % 4)) for i in range(4, 5000)]
    df = spark.createDataFrame(rows, "id int, t string, ts array<string>").coalesce(1)
    emb = em.DEFAULT_EMBEDDER
    got = df.select("id", emb.vector(F.col("t")).alias("v"), emb.flat_vectors(F.col("ts")).alias("f")).collect()
    many_got = df.filter("id in (0, 3)").select("id", emb.vectors(F.col("ts")).alias("m")).collect()
    assert len(got) == len(rows)
    by_id = {r.id: r for r in got}
    for i, t, ts in [*rows[:4], *rng.sample(rows[4:], 200)]:
        assert by_id[i].v == expected(t)
        assert by_id[i].f == [x for s in ts or [] for x in expected(s)]
    for r in many_got:
        assert [list(v) for v in r.m] == [expected(s) for s in rows[r.id][2]]
