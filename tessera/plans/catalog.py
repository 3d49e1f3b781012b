"""Registered queries: one per operator key of the inventory, on the driver tables.

Each entry takes (spark, sf_dir) and returns a DataFrame whose column names and types match
its SQL twin in :mod:`tessera.plans.oracles`. Scores are rounded to 6 places after ranking;
counts and ids are BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import cells as ce
from tessera.operators import evidence as ev
from tessera.operators import grams as gr
from tessera.operators import retrieval as rt
from tessera.operators.ordering import with_row_ids
from tessera.sources import tables as tb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


F2_THRESHOLD = 0.2  # the default 0.7 finds nothing: the largest cosine between two rows is ~0.6


def _f2_hits(spark, sf_dir, k=5, threshold=F2_THRESHOLD):
    return rt.search_similar(tb.vector_queries(spark, sf_dir), tb.vectors(spark, sf_dir),
                             tb.members(spark, sf_dir), k=k, threshold=threshold)


@register("vector_topk")
def q_vector_topk(spark, sf_dir):
    hits = rt.vector_topk(tb.vector_queries(spark, sf_dir), tb.vectors(spark, sf_dir), k=5)
    return hits.select("query_id", "task_id", "vec_id", F.col("rank").cast("long").alias("rank"),
                       r6("index_similarity").alias("index_similarity"))


@register("vector_topk_cells")
def q_vector_topk_cells(spark, sf_dir):
    """The rows of ``vector_topk`` through an index of cells that is built first."""
    hits = ce.vector_topk_cells(tb.vector_queries(spark, sf_dir), ce.build_cells(tb.vectors(spark, sf_dir)), k=5)
    return hits.select("query_id", "task_id", "vec_id", F.col("rank").cast("long").alias("rank"),
                       r6("index_similarity").alias("index_similarity"))


@register("search_similar")
def q_search_similar(spark, sf_dir):
    h = _f2_hits(spark, sf_dir)
    return h.select("query_id", "task_id", "chunk_id", "content", r6("similarity_score").alias("similarity_score"),
                    r6("index_similarity").alias("index_similarity"), F.col("cluster_id").cast("long").alias("cluster_id"),
                    F.col("rank").cast("long").alias("rank"))


def _graded_f2(spark, sf_dir, k=5, threshold=F2_THRESHOLD):
    """F2 hits; even vec_ids carry a grade ((vec_id * 37) % 101) / 100, odd ones none."""
    h = _f2_hits(spark, sf_dir, k, threshold)
    return h.withColumn("grade", F.when(F.col("vec_id") % 2 == 0, ((F.col("vec_id") * 37) % 101) / 100.0)) \
            .withColumn("score", F.col("similarity_score"))


@register("evidence_lines")
def q_evidence_lines(spark, sf_dir):
    lines = ev.evidence_lines(_graded_f2(spark, sf_dir))
    return lines.select("query_id", F.col("rank").cast("long").alias("rank"), "line")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query vector, its five best evidence lines, ranked."""
    return q_evidence_lines(spark, sf_dir)


# ---------------------------------------------------------------- text (B), sources (A1, A2, A4)
from tessera.functions import text as tx  # noqa: E402
from tessera.functions import vectors as vx  # noqa: E402
from tessera.operators import chunking as ch  # noqa: E402
from tessera.operators import embedding as em  # noqa: E402
from tessera.session import checkpoint, scratch_dir  # noqa: E402
from tessera.sources import files as fl  # noqa: E402
from tessera.sources import store as st  # noqa: E402
from tessera.sources import vector_cache as vc  # noqa: E402


def r6arr(c):
    return F.transform(F.col(c) if isinstance(c, str) else c, lambda x: F.round(x, 6))


@register("split_segments")
def q_split_segments(spark, sf_dir):
    return ch.segment_transcripts(tb.transcripts(spark, sf_dir))


@register("merge_text")
def q_merge_text(spark, sf_dir):
    t = tb.transcripts(spark, sf_dir)
    m = tx.merge_text(tx.split_segments("text"))
    return t.select("task_id", F.length(m).cast("long").alias("merged_chars"), F.md5(m).alias("merged_md5"))


@register("content_key")
def q_content_key(spark, sf_dir):
    return tb.transcripts(spark, sf_dir).select("task_id", tx.content_key("text").alias("content_key"))


def _text_parts(spark, sf_dir):
    """(_rid, query_id, task_id, query, part): each benchmark item's whole text, and its first word."""
    q = tb.text_queries(spark, sf_dir)
    words = q.select("query_id", "task_id", F.element_at(F.split(tx.strip("query"), r"(?U)\s+"), 1).alias("query"))
    both = q.select("query_id", "task_id", "query", F.lit("text").alias("part")).unionByName(
        words.withColumn("part", F.lit("word")))
    return with_row_ids(both, "_rid")


def _docs_per_part(both, hits):
    counts = hits.groupBy(F.col("query_id").alias("_rid")).agg(F.count(F.lit(1)).cast("long").alias("n_docs"))
    return both.join(counts, "_rid", "left").select(
        "query_id", "part", F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"))


@register("contains_ci")
def q_contains_ci(spark, sf_dir):
    """Documents containing each benchmark item's whole text, and its first word, any case."""
    both = _text_parts(spark, sf_dir)
    docs = tb.transcripts(spark, sf_dir).withColumn("task_id", F.lit("all"))
    hits = rt.contains_search(both.select(F.col("_rid").alias("query_id"), "task_id", "query"), docs, text_col="text")
    return _docs_per_part(both, hits)


@register("contains_ci_indexed")
def q_contains_ci_indexed(spark, sf_dir):
    """The rows of ``contains_ci`` through an index of three-character strings that is built first."""
    both = _text_parts(spark, sf_dir)
    index = gr.build_grams(tb.transcripts(spark, sf_dir).withColumn("task_id", F.lit("all")), text_col="text")
    hits = gr.contains_search_indexed(both.select(F.col("_rid").alias("query_id"), "task_id", "query"), index)
    return _docs_per_part(both, hits)


@register("clip_text")
def q_clip_text(spark, sf_dir):
    t = tb.transcripts(spark, sf_dir)
    return t.select("task_id", tx.clip_text("text", 600).alias("cut600"),
                    tx.clip_text("text", 400, "...").alias("cut400"), tx.clip_text("text", 200).alias("cut200"),
                    tx.clip_text("text", 2000).alias("cut2000"))


@register("load_transcripts")
def q_load_transcripts(spark, sf_dir):
    path = fl.write_transcripts(tb.transcripts(spark, sf_dir), scratch_dir(spark, "transcripts"))
    return fl.load_transcripts(spark, path).select("task_id", "text")


@register("transcript_info")
def q_transcript_info(spark, sf_dir):
    path = fl.write_transcripts(tb.transcripts(spark, sf_dir), scratch_dir(spark, "transcripts"))
    return fl.transcript_info(fl.load_transcripts(spark, path)).drop("modified_at")


@register("video_catalog")
def q_video_catalog(spark, sf_dir):
    return fl.video_catalog(tb.table(spark, sf_dir, "pages"))


# ---------------------------------------------------------------- embedding and vector scalars (C)
@register("embed_texts")
def q_embed_texts(spark, sf_dir):
    return em.embed_texts(tb.transcripts(spark, sf_dir), "text", ["task_id"])


@register("embed_distinct")
def q_embed_distinct(spark, sf_dir):
    out = em.embed_distinct(tb.transcripts(spark, sf_dir), "text")
    return out.select("task_id", "content_key", "vec")


@register("embed_cached")
def q_embed_cached(spark, sf_dir):
    """Two runs over one vector cache: the second finds every text there."""
    path = scratch_dir(spark, "vector-cache")
    vc.embed_cached(tb.transcripts(spark, sf_dir), "text", path)
    out = vc.embed_cached(tb.transcripts(spark, sf_dir), "text", path)
    return out.select("task_id", "content_key", "vec")


@register("cache_stats")
def q_cache_stats(spark, sf_dir):
    path = scratch_dir(spark, "vector-cache")
    vc.embed_cached(tb.transcripts(spark, sf_dir), "text", path)
    return vc.cache_report(spark, path)


def _pairs(spark, sf_dir):
    """Each embeddings row with the next id (equi-join on vec_id + 1)."""
    e = tb.vectors(spark, sf_dir).select("vec_id", "vec")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("vec").alias("vec2"))
    return e.join(nxt, "vec_id")


@register("l2_normalize")
def q_l2_normalize(spark, sf_dir):
    return tb.vectors(spark, sf_dir).select("vec_id", r6arr(vx.l2_normalize("vec")).alias("vec"))


@register("cosine_similarity")
def q_cosine(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", "next_id", r6(vx.cosine_similarity("vec", "vec2")).alias("cosine"))


@register("inner_product_clip")
def q_ip01(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select("vec_id", "next_id",
                    r6(vx.inner_product_clip(vx.l2_normalize("vec"), vx.l2_normalize("vec2"))).alias("ip01"))


@register("centroid")
def q_centroid(spark, sf_dir):
    m = tb.members(spark, sf_dir).join(tb.vectors(spark, sf_dir).select("vec_id", "vec"), "vec_id")
    return em.centroid(m, ["cluster_id"]).select(F.col("cluster_id").cast("long").alias("label"),
                                                 r6arr("center").alias("center"))


@register("blend_vectors")
def q_blend(spark, sf_dir):
    m = tb.members(spark, sf_dir).join(tb.vectors(spark, sf_dir).select("vec_id", "vec"), "vec_id")
    cent = em.centroid(m, ["cluster_id"])
    j = m.join(cent, "cluster_id")
    return j.select("vec_id", r6arr(vx.blend_vectors(vx.l2_normalize("vec"), "center", 0.5)).alias("blended"))


@register("check_dimension")
def q_check_dimension(spark, sf_dir):
    ok, bad = em.check_dimension(tb.vectors(spark, sf_dir), 64)
    return (ok.select(F.lit("ok").alias("status")).unionByName(bad.select(F.lit("rejected").alias("status")))
            .groupBy("status").agg(F.count(F.lit(1)).cast("long").alias("n")))


@register("consecutive_similarity")
def q_consecutive_similarity(spark, sf_dir):
    s = ch.segment_similarities(tb.transcripts(spark, sf_dir))
    return s.select("task_id", "seg_no", r6("sim_prev").alias("sim_prev"))


# ---------------------------------------------------------------- chunking (D)
def _chunks(spark, sf_dir):
    return ch.semantic_chunks(tb.transcripts(spark, sf_dir))


@register("adaptive_threshold")
def q_adaptive_threshold(spark, sf_dir):
    a = ch.adaptive_threshold(ch.segment_similarities(tb.transcripts(spark, sf_dir)))
    return a.select("task_id", "n_segments", r6("threshold").alias("threshold"))


@register("semantic_chunks")
def q_semantic_chunks(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return c.select("task_id", "chunk_id", "chunk_index", "seg_start", "segment_count", "word_count",
                    "character_count", r6("similarity_threshold_used").alias("similarity_threshold_used"),
                    "content")


@register("chunk_stats")
def q_chunk_stats(spark, sf_dir):
    s = ch.chunk_stats(_chunks(spark, sf_dir))
    return s.select("task_id", "total_chunks", r6("avg_chunk_size_words").alias("avg_chunk_size_words"),
                    "min_chunk_size_words", "max_chunk_size_words",
                    r6("avg_segments_per_chunk").alias("avg_segments_per_chunk"), "chunking_strategy",
                    "base_similarity_threshold")


# ---------------------------------------------------------------- store
def _written_store(spark, sf_dir):
    path = scratch_dir(spark, "store")
    st.write_chunk_store(tb.vectors(spark, sf_dir), path)
    return path


@register("write_chunk_store")
def q_write_chunk_store(spark, sf_dir):
    s = st.load_chunk_store(spark, _written_store(spark, sf_dir))
    return s.select("task_id", "vec_id", "chunk_id", "content", r6arr("vec").alias("vec"))


@register("load_chunk_store")
def q_load_chunk_store(spark, sf_dir):
    path = _written_store(spark, sf_dir)
    req = tb.vectors(spark, sf_dir).select("task_id").distinct()
    return st.next_ids(st.load_chunk_store(spark, path, req))


def _delete_requests(spark, sf_dir):
    """Task ids 't' || (label % 7): some exist (t0-t4), some do not (t5, t6)."""
    e = tb.table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("t"), (F.col("label") % 7).cast("string")).alias("task_id")).distinct()


@register("delete_tasks")
def q_delete_tasks(spark, sf_dir):
    """Per task id (requested or stored): whether anything was removed, and rows left."""
    path = _written_store(spark, sf_dir)
    req = _delete_requests(spark, sf_dir)
    ids = checkpoint(req.unionByName(st.load_chunk_store(spark, path).select("task_id")).distinct())
    flags = st.delete_from_store(spark, path, req)
    left = (st.load_chunk_store(spark, path).groupBy("task_id")  # the store as it is read afterwards
            .agg(F.count(F.lit(1)).cast("long").alias("n_remaining")))
    return (ids.join(flags, "task_id", "left").join(left, "task_id", "left")
            .select("task_id", F.coalesce("removed", F.lit(False)).alias("removed"),
                    F.coalesce("n_remaining", F.lit(0)).cast("long").alias("n_remaining")))


@register("export_docs")
def q_export_docs(spark, sf_dir):
    return st.export_docs(tb.vectors(spark, sf_dir))


@register("assign_vector_ids")
def q_assign_vector_ids(spark, sf_dir):
    """Rows with label < 5 are the stored index (ids by vec_id order), the others are appended."""
    v = tb.vectors(spark, sf_dir).join(tb.members(spark, sf_dir).select("vec_id", "cluster_id"), "vec_id")
    existing = st.assign_vector_ids(v.filter("cluster_id < 5").withColumnRenamed("vec_id", "src_id"),
                                    order_col="src_id")
    new = v.filter("cluster_id >= 5").withColumnRenamed("vec_id", "src_id")
    appended = st.assign_vector_ids(new, existing, order_col="src_id")
    return existing.unionByName(appended).select("task_id", "src_id", "vec_id")


@register("lookup_vectors")
def q_lookup_vectors(spark, sf_dir):
    store = tb.vectors(spark, sf_dir)
    req = store.select("task_id", (F.col("vec_id") + 5).alias("vec_id"))
    out = st.lookup_vectors(store, req)
    return out.select("task_id", "vec_id", "chunk_id", "content", r6arr("vec").alias("vec"))


# ---------------------------------------------------------------- clustering (E), cluster search
from tessera.operators import clustering as cl  # noqa: E402


def _vectors_with_labels(spark, sf_dir):
    return tb.vectors(spark, sf_dir).join(tb.members(spark, sf_dir).select("vec_id", "cluster_id"), "vec_id")


def _label_centres(spark, sf_dir):
    """Fixed centres: mean vector per (task, label)."""
    return em.centroid(_vectors_with_labels(spark, sf_dir), ["task_id", "cluster_id"], "vec", "center")


@register("assign_clusters")
def q_assign_clusters(spark, sf_dir):
    a = cl.assign_clusters(tb.vectors(spark, sf_dir), _label_centres(spark, sf_dir))
    return a.select("task_id", "vec_id", F.col("cluster_id").cast("long").alias("cluster_id"),
                    r6("distance").alias("distance"))


@register("lloyd_step")
def q_lloyd_step(spark, sf_dir):
    new, inertia = cl.lloyd_step(tb.vectors(spark, sf_dir), _label_centres(spark, sf_dir))
    return new.join(inertia, "task_id").select(
        "task_id", F.col("cluster_id").cast("long").alias("cluster_id"), "n_members",
        r6arr("center").alias("center"), r6("inertia").alias("inertia"))


@register("kmeans_by_task")
def q_kmeans_by_task(spark, sf_dir):
    members, _, _ = cl.kmeans_by_task(tb.vectors(spark, sf_dir), init="hashed")
    return members.select("task_id", "vec_id", F.col("cluster_id").cast("long").alias("cluster_id"))


@register("kmeans_distributed")
def q_kmeans_distributed(spark, sf_dir):
    """The same clusters by the plan of large tasks: rounds over blocks of points."""
    members, _, _ = cl.kmeans_by_task(tb.vectors(spark, sf_dir), init="hashed", local_max_rows=0)
    return members.select("task_id", "vec_id", F.col("cluster_id").cast("long").alias("cluster_id"))


@register("kmeans_parallel")
def q_kmeans_parallel(spark, sf_dir):
    """k-means|| seeding, all tasks by the distributed plan: size and inertia of each task."""
    members, _, status = cl.kmeans_by_task(tb.vectors(spark, sf_dir), local_max_rows=0)
    n = members.groupBy("task_id").agg(F.countDistinct("cluster_id").alias("n_clusters"))
    return status.join(n, "task_id", "left").select("task_id", "n_rows", "n_clusters", r6("inertia").alias("inertia"), "cluster_error")


@register("silhouette")
def q_silhouette(spark, sf_dir):
    _, per_task = cl.silhouette(_vectors_with_labels(spark, sf_dir))
    return per_task.select("task_id", r6("silhouette_score").alias("silhouette_score"))


@register("cluster_members")
def q_cluster_members(spark, sf_dir):
    m = cl.cluster_members(tb.members(spark, sf_dir))
    return m.select("task_id", F.col("cluster_id").cast("long").alias("cluster_id"), "n_members",
                    "first_member", "last_member")


def _index_meta(spark, sf_dir):
    _, sil = cl.silhouette(_vectors_with_labels(spark, sf_dir))
    return cl.index_metadata(tb.vectors(spark, sf_dir), tb.members(spark, sf_dir), sil)


@register("index_metadata")
def q_index_metadata(spark, sf_dir):
    m = _index_meta(spark, sf_dir)
    return m.drop("created_at").withColumn("silhouette_score", r6("silhouette_score"))


@register("index_statistics")
def q_index_statistics(spark, sf_dir):
    s = cl.index_statistics(_index_meta(spark, sf_dir), _delete_requests(spark, sf_dir))
    return s.withColumn("silhouette_score", r6("silhouette_score"))


def text_corpus(spark, sf_dir):
    """Chunks of all documents as one corpus (task 'all'), fixed clusters chunk_index % 5."""
    c = _chunks(spark, sf_dir)
    return c.select(F.lit("all").alias("task_id"), "chunk_id", "chunk_index", "content",
                    (F.col("chunk_index") % 5).cast("int").alias("cluster_id"))


def first_word_queries(spark, sf_dir):
    q = tb.text_queries(spark, sf_dir)
    return q.select("query_id", "task_id", F.element_at(F.split(tx.strip("query"), r"(?U)\s+"), 1).alias("query"))


@register("search_by_cluster")
def q_search_by_cluster(spark, sf_dir):
    """Chunks containing each benchmark item's whole text, or its first word, any case."""
    corpus = corpus_store(spark, sf_dir)
    both = tb.text_queries(spark, sf_dir).withColumn("part", F.lit("text")).unionByName(
        first_word_queries(spark, sf_dir).withColumn("part", F.lit("word")))
    both = with_row_ids(both, "_rid")
    hits = cl.search_by_cluster(both.select(F.col("_rid").alias("query_id"), "task_id", "query"), corpus.drop("cluster_id"),
                                corpus.select("task_id", "chunk_id", "cluster_id"))
    hits = hits.withColumnRenamed("query_id", "_rid").join(both.select("_rid", "query_id", "part"), "_rid")
    return hits.select("query_id", "part", "chunk_id", F.col("cluster_id").cast("long").alias("cluster_id"), "match_type")


# ---------------------------------------------------------------- text corpus retrieval (F3), memory
from tessera.operators import memory as mm  # noqa: E402


_STORES: dict[tuple[str, str], str] = {}


def corpus_store(spark, sf_dir):
    """Text corpus as a vector store: (task_id, vec_id, chunk_id, chunk_index, content, cluster_id, vec).

    Indexed once per session and data directory, written as a Parquet table under the shared
    checkpoint folder (what an ingestion job leaves behind), then only read by the queries.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    path = _STORES.get(key)
    if path is None:
        c = text_corpus(spark, sf_dir)
        c = c.withColumn("vec_id", (F.regexp_extract("chunk_id", r"^doc_(\d+)_", 1).cast("long") * (1 << 32)
                                    + F.col("chunk_index")).cast("long"))
        c = c.withColumn("vec", em.DEFAULT_EMBEDDER.vector(F.col("content")))
        path = scratch_dir(spark, "corpus")
        c.write.mode("overwrite").parquet(path)
        _STORES[key] = path
    return spark.read.parquet(path)


def _text_hits(spark, sf_dir, queries, store=None, k=5, threshold=0.0):
    store = store if store is not None else corpus_store(spark, sf_dir)
    q = em.DEFAULT_EMBEDDER.embed(queries, "query", ["query_id", "task_id"], "qvec")
    return rt.search_similar(q, store, store.select("task_id", "chunk_id", "cluster_id"), k=k, threshold=threshold)


@register("retrieve")
def q_retrieve(spark, sf_dir):
    h = _text_hits(spark, sf_dir, tb.text_queries(spark, sf_dir))
    return h.select("query_id", "chunk_id", r6("similarity_score").alias("similarity_score"),
                    r6("index_similarity").alias("index_similarity"),
                    F.col("cluster_id").cast("long").alias("cluster_id"), F.col("rank").cast("long").alias("rank"))


@register("ingest_summary")
def q_ingest_summary(spark, sf_dir):
    return ev.ingest_summary(_chunks(spark, sf_dir))


def memory_table(spark, sf_dir):
    """Per key: an ingest_summary at seq 0, then a query and a qa entry per user turn."""
    ut = tb.user_turns(spark, sf_dir)
    summary = ut.select("memory_key").distinct().select(
        "memory_key", F.lit(0).cast("long").alias("seq"), F.lit("ingest_summary").alias("type"),
        F.lit("").alias("text"), F.lit(None).cast("array<double>").alias("vec"))
    return summary.unionByName(mm.qa_memory_rows(ut))


@register("qa_memory_rows")
def q_qa_memory_rows(spark, sf_dir):
    return mm.qa_memory_rows(tb.user_turns(spark, sf_dir))


@register("memory_append")
def q_memory_append(spark, sf_dir):
    m = memory_table(spark, sf_dir)
    base = m.filter(F.col("seq") == 0)
    new = m.filter(F.col("seq") > 0).withColumn("ord", F.col("seq")).drop("seq")
    out = mm.memory_append(base, new)
    return out.select("memory_key", "seq", "type", "text")


@register("memory_recent")
def q_memory_recent(spark, sf_dir):
    return mm.memory_recent(memory_table(spark, sf_dir), 10).select("memory_key", "seq", "type", "text")


@register("question_line")
def q_question_line(spark, sf_dir):
    m = memory_table(spark, sf_dir).filter(F.col("type").isin("query", "qa"))
    return m.select("memory_key", "seq", tx.question_line("text").alias("question"))


def _turn_queries(spark, sf_dir):
    ut = tb.user_turns(spark, sf_dir)
    return em.DEFAULT_EMBEDDER.embed(ut, "query", ["query_id", "task_id", "memory_key", "pos", "query"], "qvec")


def _candidates(spark, sf_dir):
    return mm.memory_candidates(_turn_queries(spark, sf_dir), memory_table(spark, sf_dir))


@register("memory_candidates")
def q_memory_candidates(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    return c.select("query_id", "seq", "type", r6("sim").alias("sim"), F.col("pick").cast("long").alias("pick"))


def _centroid_hits(spark, sf_dir, store):
    return mm.centroid_retrieve(_turn_queries(spark, sf_dir), _candidates(spark, sf_dir), store,
                                store.select("task_id", "chunk_id", "cluster_id"))


def _sub_hits(spark, sf_dir, store):
    return mm.subquery_retrieve(_candidates(spark, sf_dir), tb.user_turns(spark, sf_dir), store,
                                store.select("task_id", "chunk_id", "cluster_id"))


@register("centroid_retrieve")
def q_centroid_retrieve(spark, sf_dir):
    h = _centroid_hits(spark, sf_dir, corpus_store(spark, sf_dir))
    return h.select("query_id", "chunk_id", r6("similarity_score").alias("similarity_score"),
                    F.col("rank").cast("long").alias("rank"))


@register("subquery_retrieve")
def q_subquery_retrieve(spark, sf_dir):
    h = _sub_hits(spark, sf_dir, corpus_store(spark, sf_dir))
    return h.select("query_id", F.col("pick").cast("long").alias("pick"), "chunk_id",
                    r6("similarity_score").alias("similarity_score"), F.col("rank").cast("long").alias("rank"))


def merged_hits(spark, sf_dir):
    store = corpus_store(spark, sf_dir)
    base = _text_hits(spark, sf_dir, tb.user_turns(spark, sf_dir), store).withColumn("src_ord", F.lit(0))
    cen = _centroid_hits(spark, sf_dir, store).withColumn("src_ord", F.lit(1))
    sub = _sub_hits(spark, sf_dir, store).withColumn("src_ord", F.col("pick") + 1).drop("pick")
    return mm.merge_hits(base, cen, sub)


@register("merge_hits")
def q_merge_hits(spark, sf_dir):
    m = merged_hits(spark, sf_dir)
    return m.select("query_id", "chunk_id", r6("similarity_score").alias("similarity_score"),
                    F.col("ord").cast("long").alias("ord"))


# ---------------------------------------------------------------- corrective (G), evidence (H2-H6, H9), routing (I), report
from tessera.operators import corrective as cr  # noqa: E402
from tessera.operators import routing as ro  # noqa: E402


def _strips(spark, sf_dir, k=10):
    """Graded-strip binding: F1 hits with k = 10 on the vectors, ord = rank, content attached."""
    hits = rt.vector_topk(tb.vector_queries(spark, sf_dir), tb.vectors(spark, sf_dir), k=k)
    meta = tb.vectors(spark, sf_dir).select("task_id", "vec_id", "chunk_id", "content")
    return (hits.join(meta, ["task_id", "vec_id"])
            .withColumn("ord", F.col("rank").cast("long")).withColumn("score", F.col("similarity_score")))


def _formula_grade():
    return ((F.col("vec_id") * 37) % 101) / 100.0


@register("grading_prompts")
def q_grading_prompts(spark, sf_dir):
    q = tb.vector_queries(spark, sf_dir).select("query_id", F.concat(F.lit("vec "), F.col("query_id").cast("string"))
                                                .alias("query"))
    return cr.grading_prompts(q, _strips(spark, sf_dir))


@register("parse_grades")
def q_parse_grades(spark, sf_dir):
    g = cr.parse_grades(tb.grade_completions(spark, sf_dir))
    return g.select("request_id", "elem", "chunk_id", r6("grade").alias("grade"), "reason")


@register("align_grades")
def q_align_grades(spark, sf_dir):
    s = _strips(spark, sf_dir)
    g1 = s.filter(F.col("vec_id") % 3 != 0).select("query_id", "chunk_id", F.col("rank").alias("elem"),
                                                   _formula_grade().alias("grade"),
                                                   F.concat(F.lit("r"), F.col("vec_id").cast("string")).alias("reason"))
    g2 = s.filter(F.col("vec_id") % 4 == 0).select("query_id", "chunk_id", (F.col("rank") + 100).alias("elem"),
                                                   (_formula_grade() / 2).alias("grade"), F.lit("again").alias("reason"))
    a = cr.align_grades(s, g1.unionByName(g2))
    return a.select("query_id", "chunk_id", "ord", r6("grade").alias("grade"), "grade_reason")


@register("lexical_grades")
def q_lexical_grades(spark, sf_dir):
    q = tb.text_queries(spark, sf_dir)
    hits = _text_hits(spark, sf_dir, q)
    g = cr.lexical_grades(q, hits)
    return g.select("query_id", "chunk_id", r6("grade").alias("grade"))


def _formula_graded(spark, sf_dir):
    return _strips(spark, sf_dir).withColumn("grade", _formula_grade())


@register("needs_correction")
def q_needs_correction(spark, sf_dir):
    g = _formula_graded(spark, sf_dir)
    weak = cr.needs_correction(g).select("query_id", F.lit(True).alias("_w"))
    best = g.groupBy("query_id").agg(F.max("grade").alias("best_grade"))
    return best.join(weak, "query_id", "left").select(
        "query_id", r6("best_grade").alias("best_grade"), F.coalesce("_w", F.lit(False)).alias("needs_correction"))


@register("rewrite_prompts")
def q_rewrite_prompts(spark, sf_dir):
    return cr.rewrite_prompts(tb.user_turns(spark, sf_dir))


@register("parse_rewrites")
def q_parse_rewrites(spark, sf_dir):
    return cr.parse_rewrites(tb.rewrite_completions(spark, sf_dir))


@register("keyword_rewrites")
def q_keyword_rewrites(spark, sf_dir):
    return cr.keyword_rewrites(tb.user_turns(spark, sf_dir))


@register("corrective_merge")
def q_corrective_merge(spark, sf_dir):
    """Graded = top-5 of each query; rewrites = the vectors of ids +5 and +10 (same task)."""
    vq = tb.vector_queries(spark, sf_dir)
    v = tb.vectors(spark, sf_dir)
    graded = _strips(spark, sf_dir, k=5)
    rw = []
    for no, off in ((1, 5), (2, 10)):
        q = vq.select((F.col("query_id") - off).alias("query_id"), "task_id", "qvec").filter(F.col("query_id") >= 0)
        h = rt.vector_topk(q, v, k=5).join(v.select("task_id", "vec_id", "chunk_id", "content"), ["task_id", "vec_id"])
        rw.append(h.withColumn("rewrite_no", F.lit(no)))
    m = cr.corrective_merge(graded, rw[0].unionByName(rw[1]))
    return m.select("query_id", "chunk_id", "ord")


@register("select_strips")
def q_select_strips(spark, sf_dir):
    s = cr.select_strips(_formula_graded(spark, sf_dir), 5)
    return s.select("query_id", "chunk_id", F.col("final_rank").cast("long").alias("final_rank"))


def corrective_text(spark, sf_dir, store=None):
    """One corrective round over benchmark questions: lexical grades, keyword rewrites."""
    store = store if store is not None else corpus_store(spark, sf_dir)
    q = tb.text_queries(spark, sf_dir)
    first = _text_hits(spark, sf_dir, q, store).withColumn("ord", F.col("rank").cast("long")) \
        .withColumn("score", F.col("similarity_score"))
    graded = cr.lexical_grades(q, first)

    def retrieve(rw):
        r = with_row_ids(rw, "_rid")
        hits = _text_hits(spark, sf_dir, r.select(F.col("_rid").alias("query_id"), "task_id",
                                                  F.col("rewrite").alias("query")), store)
        return (hits.withColumnRenamed("query_id", "_rid")
                .join(r.select("_rid", "query_id", "rewrite_no"), "_rid").drop("_rid"))

    return cr.corrective_rounds(q, graded, retrieve, lambda qq, s: cr.lexical_grades(qq, s))


@register("corrective_rounds")
def q_corrective_rounds(spark, sf_dir):
    c = corrective_text(spark, sf_dir)
    return c.select("query_id", "chunk_id", "ord", r6("score").alias("score"), r6("grade").alias("grade"))


@register("evidence_text")
def q_evidence_text(spark, sf_dir):
    lines = ev.evidence_lines(_graded_f2(spark, sf_dir)).withColumn("ord", F.col("rank"))
    e = ev.evidence_text(lines)
    return e.select("query_id", "evidence", "evidence_chars", "needs_digest", "evidence_cut", "evidence_digest")


def _answer_prompts(spark, sf_dir, queries, hits):
    lines = ev.evidence_lines(hits.withColumn("score", F.col("similarity_score")).withColumn("ord", F.col("rank")))
    e = ev.evidence_text(lines).withColumn("evidence", F.col("evidence_digest"))
    return ev.answer_prompts(queries, e)


@register("answer_prompts")
def q_answer_prompts(spark, sf_dir):
    q = tb.text_queries(spark, sf_dir)
    p = _answer_prompts(spark, sf_dir, q, _text_hits(spark, sf_dir, q))
    return p.select("query_id", "prompt")


@register("chat_prompts")
def q_chat_prompts(spark, sf_dir):
    return ev.chat_prompts(tb.messages(spark, sf_dir)).select("conv_id", "turn", "prompt")


@register("digest_prompts")
def q_digest_prompts(spark, sf_dir):
    return ev.digest_prompts_transcripts(tb.transcripts(spark, sf_dir)).select("task_id", "system", "prompt")


@register("digest_prompts_evidence")
def q_digest_prompts_evidence(spark, sf_dir):
    q = tb.text_queries(spark, sf_dir)
    lines = ev.evidence_lines(_text_hits(spark, sf_dir, q).withColumn("score", F.col("similarity_score")))
    over = ev.evidence_text(lines, order="rank").filter("needs_digest")
    return ev.digest_prompts_evidence(over).select("query_id", "prompt")


@register("extractive_digest")
def q_extractive_digest(spark, sf_dir):
    # The segments feed four branches (occurrences, document count, tf, final texts): written
    # once to the checkpoint folder instead of being split four times.
    segs = checkpoint(ch.segment_transcripts(tb.transcripts(spark, sf_dir)))
    return ev.extractive_digest(segs, 60)


def _assistant_completions(spark, sf_dir):
    m = tb.messages(spark, sf_dir).filter(F.col("role") == "assistant")
    return m.select((tb.turn_id("conv_id", "turn") - 1).alias("request_id"), "text",
                    F.lit(None).cast("string").alias("error"))


@register("attach_completions")
def q_attach_completions(spark, sf_dir):
    req = tb.user_turns(spark, sf_dir).select(F.col("query_id").alias("request_id"))
    out = ev.attach_completions(req, _assistant_completions(spark, sf_dir))
    return out.select("request_id", "completion", "completion_error")


@register("route_messages")
def q_route_messages(spark, sf_dir):
    r = ro.route_messages(tb.routing_flags(spark, sf_dir))
    return r.select("conv_id", "turn", "mode", "reason")


@register("router_prompts")
def q_router_prompts(spark, sf_dir):
    m = tb.messages(spark, sf_dir).filter(F.col("role") == "user")
    return ro.router_prompts(m).select("conv_id", "turn", "prompt")


@register("parse_route")
def q_parse_route(spark, sf_dir):
    return ro.parse_route(tb.route_completions(spark, sf_dir)).select("request_id", "route_mode", "route_raw")


@register("retrieval_report")
def q_retrieval_report(spark, sf_dir):
    return ev.retrieval_report(_graded_f2(spark, sf_dir, k=20, threshold=0.0), 10).select("query_id", F.col("rank").cast("long").alias("rank"), "report_line")


# ---------------------------------------------------------------- pipelines (J1-J3, A11, E2), streams (J4, J5), media (A3)
from tessera.plans import pipelines as pl  # noqa: E402
from tessera.streaming import streams as sm  # noqa: E402


@register("attach_vectors")
def q_attach_vectors(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    vecs = em.DEFAULT_EMBEDDER.embed(chunks, "content", ["task_id", "chunk_index"], "vec")
    return pl.attach_vectors(chunks, vecs).select("task_id", "chunk_id", "vec")


@register("ingest")
def q_ingest(spark, sf_dir):
    out = pl.ingest(tb.transcripts(spark, sf_dir), cluster=False)
    return out.vectors.select("task_id", "chunk_id", "vec_id", "character_count", "vec")


@register("ingest_outcome")
def q_ingest_outcome(spark, sf_dir):
    """Ingestion with clustering: index metadata, summary memory and status of every transcript."""
    out = pl.ingest(tb.transcripts(spark, sf_dir))
    meta = out.index_meta.select("task_id", "total_chunks", "embedding_model", "embedding_dimension", "cluster_error",
                                 (F.col("n_clusters") > 0).alias("clustered"))
    memory = out.memory.select(F.col("memory_key").alias("task_id"), F.col("text").alias("summary"))
    return (out.task_status.join(meta, "task_id", "left").join(memory, "task_id", "left")
            .fillna({"total_chunks": 0, "embedding_dimension": 0, "clustered": False}))


@register("task_status")
def q_task_status(spark, sf_dir):
    t = tb.transcripts(spark, sf_dir)
    return pl.task_status(t, _chunks(spark, sf_dir))


@register("answer_queries")
def q_answer_queries(spark, sf_dir):
    store = corpus_store(spark, sf_dir)
    out = pl.answer_queries(tb.user_turns(spark, sf_dir), store, store.select("task_id", "chunk_id", "cluster_id"),
                            memory_table(spark, sf_dir))
    return out.prompts


@register("answer_graded")
def q_answer_graded(spark, sf_dir):
    """Answering with correction: benchmark questions, lexical grades (cut to hundredths), keyword rewrites,
    a second retrieval where needed, the best five strips, evidence or its digest, prompt."""
    store = corpus_store(spark, sf_dir)

    def grader(queries, strips):
        g = cr.lexical_grades(queries, strips)
        return g.withColumn("grade", F.floor(F.col("grade") * 100 + 1e-9) / 100)

    out = pl.answer_queries(tb.text_queries(spark, sf_dir), store, store.select("task_id", "chunk_id", "cluster_id"), None,
                            use_memory=False, grader=grader)
    return out.prompts


@register("answer_graded_memory")
def q_answer_graded_memory(spark, sf_dir):
    """Answering with memory and correction in one call: user turns over the memory table, lexical grades cut to
    hundredths, keyword rewrites, the best five strips, evidence or its digest, prompt."""
    store = corpus_store(spark, sf_dir)

    def grader(queries, strips):
        g = cr.lexical_grades(queries, strips)
        return g.withColumn("grade", F.floor(F.col("grade") * 100 + 1e-9) / 100)

    out = pl.answer_queries(tb.user_turns(spark, sf_dir), store, store.select("task_id", "chunk_id", "cluster_id"),
                            memory_table(spark, sf_dir), grader=grader)
    return out.prompts


@register("chat_turns")
def q_chat_turns(spark, sf_dir):
    store = corpus_store(spark, sf_dir)
    out = pl.chat_turns(tb.routing_flags(spark, sf_dir).unionByName(
        tb.messages(spark, sf_dir).filter(F.col("role") != "user"), allowMissingColumns=True),
        store, store.select("task_id", "chunk_id", "cluster_id"))
    return out.select("conv_id", "turn", "mode_used", "reason", "prompt")


def _chat_with_memory(spark, sf_dir):
    """Chat turns over one memory per task, begun by a summary entry; the assistant's turns are the answers."""
    store = corpus_store(spark, sf_dir)
    return pl.chat_session(tb.routing_flags(spark, sf_dir).unionByName(
        tb.messages(spark, sf_dir).filter(F.col("role") != "user"), allowMissingColumns=True),
        store, store.select("task_id", "chunk_id", "cluster_id"), memory=tb.first_memory(spark), use_memory=True,
        answers=tb.given_answers(spark, sf_dir))


@register("chat_turns_memory")
def q_chat_turns_memory(spark, sf_dir):
    return _chat_with_memory(spark, sf_dir).turns.select("conv_id", "turn", "mode_used", "reason", "prompt")


@register("chat_memory_rows")
def q_chat_memory_rows(spark, sf_dir):
    """The rows that the chat turns append to the memory."""
    return _chat_with_memory(spark, sf_dir).memory_rows


@register("ingest_stream")
def q_ingest_stream(spark, sf_dir):
    src = scratch_dir(spark, "incoming")
    fl.write_transcript_files(tb.transcripts(spark, sf_dir), src)
    store = scratch_dir(spark, "stream-store")
    q = sm.ingest_stream(spark, src, store, scratch_dir(spark, "stream-ckpt"))
    q.awaitTermination()
    chunks = st.read_table(spark, store, "chunks").groupBy("task_id").agg(F.count(F.lit(1)).cast("long").alias("n_chunks"))
    meta = st.read_table(spark, store, "index_meta").select("task_id", "total_chunks", "cluster_error")
    status = st.read_table(spark, store, "task_status").select("task_id", "status")
    return (status.join(chunks, "task_id", "left").join(meta, "task_id", "left")
            .fillna({"n_chunks": 0, "total_chunks": 0}))


@register("question_stream")
def q_question_stream(spark, sf_dir):
    """Messages in three micro-batches, by conversation; memory and histories are carried in streaming state."""
    store = corpus_store(spark, sf_dir)
    out, src = scratch_dir(spark, "answers"), scratch_dir(spark, "messages")
    m = tb.messages(spark, sf_dir)
    low, high = m.agg(F.min("conv_id"), F.max("conv_id")).first()
    third = F.floor((F.col("conv_id") - F.lit(low)) * 3 / F.lit((high or 0) - (low or 0) + 1))
    for k in range(3):  # one file each: files are taken in the order of their times
        m.filter(third == k).withColumn("task_id", F.lit("all")).coalesce(1).write.mode("append").parquet(src)
    q = sm.question_stream(spark, src, store, store.select("task_id", "chunk_id", "cluster_id"), out,
                           scratch_dir(spark, "q-ckpt"), schema="conv_id long, turn long, role string, text string, task_id string",
                           route_flags={"chat_only": False, "force_rag": False, "auto_retrieve": True},
                           memory=tb.first_memory(spark), answers=tb.given_answers(spark, sf_dir), max_files=1)
    q.awaitTermination()
    return spark.read.parquet(f"{out}/turns").select("conv_id", "turn", "mode_used", "reason", "prompt")


@register("media_catalog")
def q_media_catalog(spark, sf_dir):
    pages = tb.table(spark, sf_dir, "pages")
    cat = fl.video_catalog(pages)
    named = cat.join(pages.select("page_id", "html"), "page_id").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("_"),
                 F.regexp_replace("title", "[^A-Za-z0-9]+", "-"), F.lit(".mp3")).alias("name"),
        F.col("html").alias("body"))
    d = scratch_dir(spark, "media")
    fl.write_named_files(named, d, "name", "body").count()
    ids = pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("task_id"))
    m = fl.match_media_to_tasks(fl.media_catalog(spark, d), ids)
    return m.select("task_id", "title", F.col("file_size").cast("long").alias("file_size"))
