"""Golden cases taken from the original project's tests (inputs and expected outcomes)."""

import numpy as np
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.operators import chunking as ch
from tessera.operators import clustering as cl
from tessera.operators import embedding as em
from tessera.operators import evidence as ev
from tessera.operators import retrieval as rt
from tessera.plans import pipelines as pl
from tessera.session import scratch_dir
from tessera.sources import store as st


def one_hot(i, d):
    v = [0.0] * d
    v[i] = 1.0
    return v


def test_one_hot_index_and_reload(spark):
    rows = [("t", i, f"doc{i}", f"doc{i}", one_hot(i, 4)) for i in range(4)]
    vecs = spark.createDataFrame(rows, "task_id string, vec_id long, chunk_id string, content string, vec array<double>")
    q = spark.createDataFrame([(0, "t", one_hot(0, 4))], "query_id long, task_id string, qvec array<double>")
    hits = rt.search_similar(q, vecs, None, k=3, threshold=0.0).orderBy("rank").collect()
    assert hits[0]["content"] == "doc0" and 0.99 <= hits[0]["similarity_score"] <= 1.0
    assert [h["content"] for h in hits[1:]] == ["doc1", "doc2"]
    assert all(h["similarity_score"] == 0.0 for h in hits[1:])
    path = scratch_dir(spark, "golden-store")
    st.write_chunk_store(vecs, path)
    again = rt.search_similar(q, st.load_chunk_store(spark, path), None, k=3, threshold=0.0).orderBy("rank").collect()
    assert [h["content"] for h in again] == [h["content"] for h in hits]


def test_index_service_threshold_and_no_clusters(spark):
    rows = [("t", i, str(i), c, one_hot(i, 4)) for i, c in enumerate(["alpha", "beta", "gamma"])]
    vecs = spark.createDataFrame(rows, "task_id string, vec_id long, chunk_id string, content string, vec array<double>")
    members, _, status = cl.kmeans_by_task(vecs)
    assert members.count() == 0
    s = status.collect()[0]
    assert s["cluster_error"] is not None and s["n_rows"] == 3
    q = spark.createDataFrame([(0, "t", one_hot(0, 4))], "query_id long, task_id string, qvec array<double>")
    hits = rt.search_similar(q, vecs, members.withColumn("chunk_id", F.col("vec_id").cast("string")),
                             k=2, threshold=0.5).collect()
    assert len(hits) == 1
    h = hits[0]
    assert h["chunk_id"] == "0" and 0.9 <= h["similarity_score"] <= 1.0 and h["rank"] == 1 and h["cluster_id"] is None


def test_same_content_stored_several_times(spark):
    rows = [("t", i, f"c{i}", f"doc{i}", one_hot(i, 8)) for i in range(8)]
    vecs = spark.createDataFrame(rows, "task_id string, vec_id long, chunk_id string, content string, vec array<double>")
    path = scratch_dir(spark, "golden-repeat")
    for _ in range(3):
        st.write_chunk_store(vecs, path)
    assert st.load_chunk_store(spark, path).count() == 8


def test_text_query_equals_vector_query(spark):
    e0 = np.array(one_hot(0, 4))
    emb = em.PandasEmbedder(lambda: (lambda texts: np.tile(e0, (len(texts), 1))), 4, "constant")
    rows = [("t", 0, "0", "alpha", one_hot(0, 4)), ("t", 1, "1", "beta", one_hot(1, 4))]
    vecs = spark.createDataFrame(rows, "task_id string, vec_id long, chunk_id string, content string, vec array<double>")
    tq = emb.embed(spark.createDataFrame([(0, "t", "anything")], "query_id long, task_id string, query string"),
                   "query", ["query_id", "task_id"], "qvec")
    vq = spark.createDataFrame([(0, "t", one_hot(0, 4))], "query_id long, task_id string, qvec array<double>")
    a = rt.search_similar(tq, vecs, None, k=1, threshold=0.0).collect()
    b = rt.search_similar(vq, vecs, None, k=1, threshold=0.0).collect()
    assert a[0]["chunk_id"] == b[0]["chunk_id"] == "0"


SAMPLE = (
    "Bonjour. Ceci est un test. "
    "Le modèle doit segmenter ce texte en phrases. "
    "Ensuite, il doit agréger des phrases similaires pour créer des chunks cohérents. "
    "Ce paragraphe parle de développement web et machine learning. "
    "La programmation Python est au coeur du ML. "
    "Enfin, on vérifie que le chunking retourne des chunks et des métadonnées."
)


def test_sample_transcript_with_parallel_embedder(spark):
    emb = em.PandasEmbedder(lambda: (lambda texts: np.array([[float(len(t) % 7 + 1)] * 16 for t in texts])),
                            16, "len-mod-7")
    t = spark.createDataFrame([("t1", SAMPLE)], "task_id string, text string")
    segs = ch.segment_transcripts(t).collect()
    assert len(segs) == 7
    chunks = ch.semantic_chunks(t, Settings(), emb).collect()
    assert len(chunks) == 1
    c = chunks[0]
    assert c["chunk_id"] == "t1_semantic_chunk_0"
    assert c["character_count"] == 333 and c["word_count"] == 54
    assert abs(c["similarity_threshold_used"] - 0.65) < 1e-12
    stats = ch.chunk_stats(ch.semantic_chunks(t, Settings(), emb)).collect()[0]
    assert stats["total_chunks"] == 1 and stats["chunking_strategy"] == "semantic_dynamic"


def test_embedder_contract(spark):
    emb = em.PandasEmbedder(lambda: (lambda texts: np.array([[float(len(t) % 10 + 1)] * 8 for t in texts])),
                            8, "len-mod-10")
    df = spark.createDataFrame([(0, "a"), (1, "bb"), (2, "ccc"), (3, "a")], "id long, text string")
    out = {r["id"]: r["vec"] for r in emb.embed(df, "text", ["id"]).collect()}
    assert [out[i][0] for i in range(3)] == [2.0, 3.0, 4.0]
    assert out[0] == out[3] and len(out[1]) == 8


def test_stubbed_pipeline_answer_passes_through(spark):
    chunks = spark.createDataFrame([("t", "c1", 0, "first chunk"), ("t", "c2", 1, "second chunk")],
                                   "task_id string, chunk_id string, chunk_index long, content string")
    transcripts = spark.createDataFrame([("t", "x")], "task_id string, text string")
    status = pl.task_status(transcripts, chunks).collect()[0]
    assert status["status"] == "completed"
    prompts = spark.createDataFrame([(1,)], "request_id long")
    comp = spark.createDataFrame([(1, "This is a dummy answer.", None)], "request_id long, text string, error string")
    out = ev.attach_completions(prompts, comp).collect()[0]
    assert out["completion"] == "This is a dummy answer." and out["completion_error"] is None
