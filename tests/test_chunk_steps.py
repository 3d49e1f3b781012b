"""Chunking keeps segment vectors in the Python worker: one similarity per segment comes back, for any transcript."""

import math
import random

import numpy as np
import pyarrow as pa

from tessera.functions import vectors as vx
from tessera.operators import chunking as ch
from tessera.operators import embedding as em


def sentence(rng):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Straße", "漢字"]) for _ in range(rng.randint(1, 9))).capitalize() + "."


def transcripts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "task_id int, text string")


def test_blank_and_null_transcripts_have_no_chunks(spark):
    t = transcripts(spark, [None, "", " \n ", "One sentence. " + "Another one here. " * 12])
    assert {r.task_id for r in ch.semantic_chunks(t).collect()} == {3}
    assert {r.task_id for r in ch.segment_similarities(t).collect()} == {3}


def test_no_vector_of_a_segment_reaches_the_jvm(spark):
    t = transcripts(spark, ["One. Two."])
    for df in (ch.semantic_chunks(t), ch.segment_similarities(t)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "_flat" not in plan and "vecs" not in plan


def test_lists_longer_than_a_piece(monkeypatch):
    rng = random.Random(7)
    lists = [[sentence(rng) if i % 9 else "" for i in range(n)] for n in (0, 1, 5, 200, 2, 0, 64, 33)]
    want = []
    for texts in lists:
        m = em.DEFAULT_EMBEDDER._counter(64, 1 << 20)(texts, len(texts))
        dots = [(float(a @ b), float(a @ a), float(b @ b)) for a, b in zip(m, m[1:])]
        want.append([None][:len(texts)] + [d / (math.sqrt(x) * math.sqrt(y)) if x and y else 0.0 for d, x, y in dots])
    for n in (4096, 64, 3, 1):
        monkeypatch.setattr(em, "PIECE_TEXTS", n)
        parts = em.DEFAULT_EMBEDDER.list_sims()(pa.array([*lists, None], pa.list_(pa.string())))
        assert [x for p in parts for x in p.to_pylist()] == [*want, []]


def test_similarities_equal_those_of_the_vector_columns(spark):
    rng = random.Random(8)
    many = [sentence(rng) if i % 50 else "" for i in range(em.PIECE_TEXTS + 10)]
    model = em.PandasEmbedder(lambda: lambda texts: np.array([[len(t) / 7, t.count("a") / 3, 1e-3] for t in texts]), 3, "lengths")
    df = spark.createDataFrame([(0, many), (1, None), (2, []), (3, many[:3])], "id int, ts array<string>").coalesce(1)
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(many, many[1:]))], "i int, a string, b string")
    for emb in (em.DEFAULT_EMBEDDER, model):
        got = {r.id: r.s for r in df.select("id", em.neighbour_sims("ts", emb).alias("s")).collect()}
        vecs = pairs.select("i", emb.vector("a").alias("va"), emb.vector("b").alias("vb"))
        want = vecs.select("i", vx.cosine_similarity("va", "vb").alias("s")).orderBy("i").collect()
        assert got[0][0] is None and got[1] == [] and got[2] == [] and got[3] == got[0][:3]
        assert got[0][1:] == [r.s for r in want]


def test_a_fold_without_numbers_follows_sql():
    assert ch._fold([], [], 0.65, 2000) == []
    assert ch._fold([None], [5], 0.65, 2000) == [(0, 1, 5, 0.65)]
    nan = float("nan")
    assert ch._fold([None, nan, nan], [5, 5, 5], 0.65, 2000) == [(0, 3, 17, 0.9)]  # NaN is above every number
    assert ch._fold([None, None], [5, 5], 0.65, 2000) == [(0, 1, 5, 0.65), (1, 1, 5, 0.65)]
