"""End-to-end plans: ingestion (J1, A11), answering (J2), chat turns.

Outputs are lazy DataFrame plans over a few tables written on the way (requests, numbered rows,
bounded hits) to the shared checkpoint folder. Model calls are table boundaries: prompts leave
as rows, completions come back as rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.operators import chunking as ch
from tessera.operators import clustering as cl
from tessera.operators import embedding as em
from tessera.operators import evidence as ev
from tessera.operators import memory as mm
from tessera.operators import retrieval as rt
from tessera.operators import routing as ro
from tessera.session import checkpoint

FAILED_NO_CHUNKS = "Index creation failed: No embeddings provided to build the index"
COMPLETED = "Hybrid index created successfully"


@dataclass
class Ingested:
    chunks: DataFrame
    vectors: DataFrame
    members: DataFrame | None
    index_meta: DataFrame
    memory: DataFrame
    task_status: DataFrame


def chunk_vectors(chunks: DataFrame, embedder=None, dedup: bool = False) -> DataFrame:
    """E2 + E1: chunks paired with their vectors (by key) and dense ids per task.

    With ``dedup`` each distinct chunk text is embedded once (C2) — worth it for a costly model.
    """
    if dedup:
        v = em.embed_distinct(chunks, "content", embedder).drop("content_key")
    else:
        v = chunks.withColumn("vec", (embedder or em.DEFAULT_EMBEDDER).vector(F.col("content")))
    # A fresh index numbers its vectors in chunk order, and chunk_index is already dense from
    # 0 per task (assigned in-row by the fold): no numbering pass is needed.
    return v.withColumn("vec_id", F.col("chunk_index").cast("long"))


def attach_vectors(chunks: DataFrame, vecs: DataFrame) -> DataFrame:
    """Pair chunks with vectors computed apart, by (task_id, chunk_index)."""
    return chunks.join(vecs.select("task_id", "chunk_index", "vec"), ["task_id", "chunk_index"], "inner")


def task_status(transcripts: DataFrame, chunks: DataFrame, upstream: DataFrame | None = None) -> DataFrame:
    """One outcome per task; a task without chunks fails at the index stage.

    ``upstream``: (task_id, stage_no, stage, status, message, error) of the stages before. The first
    stage that did not complete decides, and nothing after it is reported.
    """
    n = chunks.groupBy("task_id").agg(F.count(F.lit(1)).cast("long").alias("n_chunks"))
    j = transcripts.select("task_id").join(n, "task_id", "left")
    ok = F.coalesce(F.col("n_chunks"), F.lit(0)) > 0
    own = F.struct(F.lit("index").alias("stage"), F.when(ok, F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
                   F.when(ok, F.lit(COMPLETED)).otherwise(F.lit(FAILED_NO_CHUNKS)).alias("message"),
                   F.when(~ok, F.lit("No embeddings provided to build the index")).alias("error"))
    if upstream is not None:
        stopped = (upstream.filter(~F.col("status").eqNullSafe("completed")).groupBy("task_id")
                   .agg(F.min_by(F.struct("stage", "status", "message", "error"), "stage_no").alias("_u")))
        j = j.join(stopped, "task_id", "full")
        own = F.coalesce("_u", own)
    return (j.withColumn("_s", own)
            .select("task_id", "_s.stage", "_s.status", "_s.message", "_s.error",
                    F.coalesce(F.col("n_chunks"), F.lit(0)).cast("long").alias("n_chunks")))


def ingest(transcripts: DataFrame, cfg: Settings = Settings(), embedder=None, cluster: bool = True,
           dedup: bool = False) -> Ingested:
    """Chunk -> embed -> index -> cluster -> summary memory -> task status, for all transcripts."""
    emb = embedder or em.DEFAULT_EMBEDDER
    # Segmentation and embedding run once; every output is derived from the written vectors.
    vectors = checkpoint(chunk_vectors(ch.semantic_chunks(transcripts, cfg, embedder), embedder, dedup))
    chunks = vectors.drop("vec", "vec_id")
    members = sil = status = None
    if cluster:
        m, _, status = cl.kmeans_by_task(vectors, cfg=cfg)
        members = m.join(vectors.select("task_id", "vec_id", "chunk_id"), ["task_id", "vec_id"])
        _, sil = cl.silhouette(vectors.join(m, ["task_id", "vec_id"]))
    meta = cl.index_metadata(vectors, members, sil, cfg, model=getattr(emb, "name", None), status=status)
    summary = ev.ingest_summary(chunks).select(
        F.col("task_id").alias("memory_key"), F.lit(0).cast("long").alias("seq"), "type", "text",
        F.lit(None).cast("array<double>").alias("vec"))
    return Ingested(chunks, vectors, members, meta, summary, task_status(transcripts, chunks))


@dataclass
class Answered:
    prompts: DataFrame
    provenance: DataFrame
    used_memory: DataFrame
    memory_rows: DataFrame | None


def answer_queries(queries: DataFrame, store: DataFrame, members: DataFrame | None, memory: DataFrame | None,
                   cfg: Settings = Settings(), completions: DataFrame | None = None, embedder=None,
                   use_memory: bool = True, k: int | None = None, threshold: float | None = None,
                   grader=None, rewriter=None) -> Answered:
    """Retrieve -> memory -> merge -> evidence -> prompt (-> answer -> memory rows).

    ``queries``: (query_id, task_id, query[, memory_key, pos]). ``store``: (task_id, vec_id,
    chunk_id, content, vec). With ``completions``, an over-budget question takes its digest
    completion, or, if that is missing or empty, the first ``max_evidence_chars`` (the original's
    fallback for a failed digest). Without any, the offline digest of :func:`evidence.evidence_text`.

    Corrective mode: with ``grader`` ((queries, strips) -> grade rows, e.g. parsed grader
    completions or :func:`corrective.lexical_grades`) the first strips are graded, weak
    questions go through :func:`corrective.corrective_rounds` with ``rewriter`` (default
    :func:`corrective.keyword_rewrites`), and the best k by (grade, score) are kept (G11).
    """
    k = cfg.k if k is None else k
    threshold = cfg.answer_threshold if threshold is None else threshold
    emb = embedder or em.DEFAULT_EMBEDDER
    keys = [c for c in ("query_id", "task_id", "memory_key", "pos", "query") if c in queries.columns]
    # The embedded questions and the memory picks feed several searches; they are written once.
    qv = checkpoint(emb.embed(queries, "query", keys, "qvec"))
    # All searches of a question (its own vector, the memory-shifted vector, one per picked
    # memory's question line) become requests (query_id, src_ord) with their own k, so the store
    # is scanned once for all of them.
    req = qv.select("query_id", F.lit(0).alias("src_ord"), "task_id", "qvec", F.lit(k).alias("k_row"))
    used = queries.limit(0).select("query_id")
    if use_memory and memory is not None:
        cands = checkpoint(mm.memory_candidates(qv, memory, cfg))
        cen = mm.centroid_queries(qv, cands, cfg)
        sub = mm.subquery_queries(cands, queries, emb)
        req = req.unionByName(cen.select("query_id", F.lit(1).alias("src_ord"), "task_id", "qvec", F.lit(k).alias("k_row")))
        req = req.unionByName(sub.select("query_id", (F.col("pick") + 1).cast("int").alias("src_ord"), "task_id", "qvec",
                                         F.lit(max(2, k // 2)).alias("k_row")))
        used = mm.memory_window(queries.select("query_id", "memory_key", "pos"), memory, cfg.memory_window)
    hits = rt.search_requests(req, store, members, keys=["query_id", "src_ord"], k=k, threshold=threshold, cfg=cfg,
                              k_col="k_row")
    merged = mm.merge_hits(hits).withColumn("score", F.col("similarity_score"))
    if grader is not None:
        from tessera.operators import corrective as cr

        graded = cr.apply_grades(merged, grader(queries, merged.filter(F.col("ord") <= cfg.grade_max_items)),
                                 cfg.grade_max_items)

        def retrieve(rw: DataFrame) -> DataFrame:
            rq = emb.embed(rw, "rewrite", ["query_id", "rewrite_no", "task_id"], "qvec")
            return rt.search_requests(rq, store, members, keys=["query_id", "rewrite_no"], k=k, threshold=threshold, cfg=cfg)

        graded = cr.corrective_rounds(queries, graded, retrieve, grader, rewriter or cr.keyword_rewrites, cfg)
        merged = cr.select_strips(graded, k).withColumn("ord", F.col("final_rank"))
    lines = ev.evidence_lines(merged)
    evidence = ev.evidence_text(lines, "query_id", "ord", cfg.max_evidence_chars)
    if completions is not None:
        digest = completions.filter(F.col("stage") == "digest").select(
            F.col("request_id").alias("query_id"), F.col("text").alias("_digest"))
        evidence = (evidence.join(digest, "query_id", "left")
                    .withColumn("evidence", F.when(F.col("needs_digest"),
                                                   F.coalesce(F.nullif("_digest", F.lit("")), F.col("evidence_cut")))
                                .otherwise(F.col("evidence"))).drop("_digest"))
    else:
        evidence = evidence.withColumn("evidence", F.col("evidence_digest"))
    prompts = ev.answer_prompts(queries.select("query_id", "query"), evidence)
    memory_rows = None
    if completions is not None and "memory_key" in queries.columns:
        answers = completions.filter(F.col("stage") == "answer").select(
            F.col("request_id").alias("query_id"), F.col("text").alias("answer"))
        memory_rows = mm.qa_memory_rows(queries.drop("answer").join(answers, "query_id", "left"), emb)
    return Answered(prompts.select("query_id", "prompt"), merged, used, memory_rows)


@dataclass
class Chatted:
    """``turns``: (conv_id, turn, mode_used, reason, prompt); ``memory_rows``: what the turns add to the memory, or None."""

    turns: DataFrame
    memory_rows: DataFrame | None


def chat_session(messages: DataFrame, store: DataFrame, members: DataFrame | None, cfg: Settings = Settings(),
                 embedder=None, memory: DataFrame | None = None, use_memory: bool = False,
                 answers: DataFrame | None = None, grader=None, rewriter=None) -> Chatted:
    """Route each user turn, then an answer prompt (rag) or a chat prompt (chat).

    ``messages``: user and assistant rows (conv_id, turn, role, text) with routing flags on the
    user rows.

    With ``use_memory`` the turns routed to retrieval share one memory per task, as in the
    original: each such turn, in (conv_id, turn) order, sees the memory written before it
    (``memory``, e.g. ingest summaries) plus the query and Q/A entries of the earlier
    retrieval turns, whose answers come from ``answers`` (conv_id, turn, answer). Those entries are
    returned as the rows to append. ``grader`` and ``rewriter`` as in :func:`answer_queries`.
    """
    from tessera.operators.ordering import positions, with_row_ids

    routed = ro.route_messages(messages.filter(F.col("role") == "user"))
    rag = with_row_ids(routed.filter(F.col("mode") == "rag")
                       .select("task_id", F.col("text").alias("query"), "conv_id", "turn", "mode", "reason"), "query_id")
    turns = rag.select("query_id", "conv_id", "turn", "mode", "reason")
    rag = rag.drop("mode", "reason")
    written = None
    if use_memory:
        base = memory if memory is not None else rag.sparkSession.createDataFrame(
            [], "memory_key string, seq long, type string, text string, vec array<double>")
        top = base.groupBy("memory_key").agg(F.max("seq").alias("_top"))
        rag = (positions(rag.withColumn("memory_key", F.col("task_id")), "memory_key", ["conv_id", "turn"], "_j")
               .join(top, "memory_key", "left")
               .withColumn("pos", (F.coalesce(F.col("_top"), F.lit(-1)) + 2 * F.col("_j")).cast("long"))
               .drop("_j", "_top"))
        given = answers if answers is not None else rag.select("conv_id", "turn", F.lit("").alias("answer"))
        # pos is the last seq a turn may see; its own entries take pos + 1 and pos + 2.
        written = checkpoint(mm.qa_memory_rows(rag.join(given.select("conv_id", "turn", "answer"), ["conv_id", "turn"], "left"), embedder)
                             .select("memory_key", "seq", "type", "text", "vec"))
        memory = base.unionByName(written)
    ans = answer_queries(rag, store, members, memory, cfg, embedder=embedder, use_memory=use_memory, grader=grader, rewriter=rewriter)
    rag_out = turns.join(ans.prompts, "query_id", "left").select("conv_id", "turn", "mode", "reason", "prompt")
    chat = ev.chat_prompts(messages.select("conv_id", "turn", "role", "text"))
    chat_out = (routed.filter(F.col("mode") == "chat").select("conv_id", "turn", "mode", "reason")
                .join(chat.select("conv_id", "turn", "prompt"), ["conv_id", "turn"], "left"))
    return Chatted(rag_out.unionByName(chat_out).withColumnRenamed("mode", "mode_used"), written)


def chat_turns(messages: DataFrame, store: DataFrame, members: DataFrame | None, cfg: Settings = Settings(), **options) -> DataFrame:
    """The turns of :func:`chat_session`: (conv_id, turn, mode_used, reason, prompt)."""
    return chat_session(messages, store, members, cfg, **options).turns
