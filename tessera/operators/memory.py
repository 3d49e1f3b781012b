"""Keyed, append-only memory and memory-widened retrieval.

Memory rows: (memory_key, seq, type, text, vec). ``seq`` is dense per key and gives the
insertion order. A question at position ``pos`` sees only entries with ``seq <= pos`` (it
never sees memory written after it), and at most the last ``window`` of them, whatever
their type. The look-back is an equi-join on (memory_key, pos - n) for n in [0, window):
no range join, no cross join, and a hot key is spread over the join like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions import text as tx
from tessera.functions import vectors as vx
from tessera.operators.embedding import DEFAULT_EMBEDDER
from tessera.operators.retrieval import search_requests, search_similar

MEMORY_TYPES = ("query", "qa")


def memory_append(memory: DataFrame, new: DataFrame, order_col: str = "ord") -> DataFrame:
    """Append entries per key after the largest ``seq``, in ``order_col`` order.

    The offset is a grouped max (one row per key); the new rows are numbered with
    :func:`positions`, so a hot key is not numbered in one task. ``order_col`` must be unique
    within a key.
    """
    from tessera.operators.ordering import positions

    top = memory.groupBy("memory_key").agg(F.max("seq").alias("_top"))
    added = (positions(new, "memory_key", [order_col], "_p").join(top, "memory_key", "left")
             .withColumn("seq", (F.coalesce(F.col("_top"), F.lit(-1)) + F.col("_p") + 1).cast("long"))
             .drop("_top", "_p", order_col))
    return memory.unionByName(added, allowMissingColumns=True)


def memory_recent(memory: DataFrame, limit: int = 10) -> DataFrame:
    """The last ``limit`` entries per key, in insertion order (per-key top-n, limited
    per partition before the shuffle)."""
    w = Window.partitionBy("memory_key").orderBy(F.desc("seq"))
    return memory.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def memory_window(queries: DataFrame, memory: DataFrame, window: int = Settings().memory_window) -> DataFrame:
    """The last ``window`` memory entries at or before each question's position (all types)."""
    q = queries.select("query_id", "memory_key", "pos", F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("_n"))
    q = q.withColumn("seq", F.col("pos") - F.col("_n")).filter(F.col("seq") >= 0).drop("_n")
    return q.join(memory, ["memory_key", "seq"], "inner")


def memory_candidates(queries: DataFrame, memory: DataFrame, cfg: Settings = Settings(),
                      qvec: str = "qvec") -> DataFrame:
    """of the window, keep query/qa entries with a vector, score by clipped cosine, keep
    those >= min similarity, best ``top_n`` (ties: earlier entry first).

    ``queries``: (query_id, memory_key, pos, qvec); ``memory``: (memory_key, seq, type, text, vec).
    """
    # Normalise once per memory entry and once per question, before the look-back join fans
    # each question out to its window; per pair only the dot product remains.
    mem = (memory.filter(F.col("type").isin(*MEMORY_TYPES) & F.col("vec").isNotNull())
           .withColumn("_mn", vx.l2_normalize("vec")))
    win = memory_window(queries.select("query_id", "memory_key", "pos"), mem, cfg.memory_window)
    j = win.join(queries.select("query_id", vx.l2_normalize(qvec).alias("_qn")), "query_id")
    sim = vx.inner_product_clip("_qn", "_mn")
    scored = j.withColumn("sim", sim).filter(F.col("sim") >= F.lit(cfg.memory_min_similarity))
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), F.asc("seq"))
    return (scored.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= cfg.memory_top_n)
            .select("query_id", "memory_key", "seq", "type", "text", "vec", "sim", "pick"))


def centroid_queries(queries: DataFrame, candidates: DataFrame, cfg: Settings = Settings(),
                     qvec: str = "qvec") -> DataFrame:
    """F6 query side: normalise(q + alpha * mean(picked memory vectors)), both normalised first.

    Picks are at most ``top_n`` per query, so the mean is an in-row fold over a bounded list.
    """
    picked = (candidates.groupBy("query_id")
              .agg(F.collect_list(vx.l2_normalize("vec")).alias("_vs")))
    dim_mean = F.transform(F.element_at("_vs", 1), lambda _, i: F.aggregate(
        F.col("_vs"), F.lit(0.0), lambda acc, v: acc + v[i]) / F.size("_vs"))
    q = (queries.join(picked, "query_id", "inner")
         .withColumn("_m", dim_mean)
         .withColumn("qvec2", vx.blend_vectors(vx.l2_normalize(qvec), "_m", cfg.memory_alpha)))
    return q.select("query_id", "task_id", F.col("qvec2").alias("qvec"))


def centroid_retrieve(queries: DataFrame, candidates: DataFrame, store: DataFrame, members: DataFrame | None,
                      cfg: Settings = Settings(), k: int | None = None, threshold: float | None = None,
                      qvec: str = "qvec") -> DataFrame:
    """search with the memory-shifted query vector."""
    k = cfg.k if k is None else k
    threshold = cfg.answer_threshold if threshold is None else threshold
    return search_similar(centroid_queries(queries, candidates, cfg, qvec), store, members,
                          k=k, threshold=threshold, cfg=cfg)


def subquery_queries(candidates: DataFrame, queries: DataFrame, embedder=None) -> DataFrame:
    """F7 query side: the question line of each picked memory, embedded: (query_id, pick, task_id, qvec)."""
    emb = embedder or DEFAULT_EMBEDDER
    sub = (candidates.select("query_id", "pick", tx.question_line("text").alias("subq"))
           .filter(F.col("subq") != "")
           .join(queries.select("query_id", "task_id"), "query_id"))
    return emb.embed(sub, "subq", ["query_id", "pick", "task_id"], "qvec")


def subquery_retrieve(candidates: DataFrame, queries: DataFrame, store: DataFrame, members: DataFrame | None,
                      cfg: Settings = Settings(), k: int | None = None, threshold: float | None = None,
                      embedder=None) -> DataFrame:
    """one more search per picked memory, with its question line, k' = max(2, k // 2).

    Each (query, pick) is its own request; the result keeps ``pick``.
    """
    k = cfg.k if k is None else k
    threshold = cfg.answer_threshold if threshold is None else threshold
    sq = subquery_queries(candidates, queries, embedder)
    return search_requests(sq, store, members, keys=["query_id", "pick"], k=max(2, k // 2), threshold=threshold, cfg=cfg)


def merge_hits(*sources: DataFrame) -> DataFrame:
    """F8: union all, drop empty chunk ids, keep the best score per (query, chunk) — the
    earlier occurrence wins a tie — and order by score (``ord`` from 1).

    Each source carries (query_id, chunk_id, similarity_score, ...) plus ``src_ord`` (its
    position in the merge order) and ``rank`` within the source.
    """
    u = sources[0]
    for s in sources[1:]:
        u = u.unionByName(s, allowMissingColumns=True)
    u = u.filter(F.col("chunk_id").isNotNull() & (F.col("chunk_id") != ""))
    occ = Window.partitionBy("query_id", "chunk_id")
    # One pass over each (query, chunk) group: the best occurrence and the first position seen.
    best = (u.withColumn("_r", F.row_number().over(occ.orderBy(F.desc("similarity_score"), "src_ord", "rank")))
            .withColumn("_first", F.min(F.struct("src_ord", "rank")).over(occ))
            .filter("_r = 1").drop("_r"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity_score"), F.col("_first"))
    return best.withColumn("ord", F.row_number().over(w)).drop("_first")


def qa_text(query, answer):
    """Text of a Q/A entry; a missing answer is empty."""
    return F.concat(F.lit("Q: "), query, F.lit("\nA: "), F.coalesce(answer, F.lit("")))


def qa_memory_rows(answered: DataFrame, embedder=None) -> DataFrame:
    """H8: two memory rows per answered question: the question, and ``Q: ...\\nA: ...``.

    ``answered``: (memory_key, pos, query, answer). The rows take seq pos + 1 and pos + 2.
    """
    emb = embedder or DEFAULT_EMBEDDER
    rows = answered.select("memory_key", F.explode(F.array(
        F.struct((F.col("pos") + 1).alias("seq"), F.lit("query").alias("type"), F.col("query").alias("text")),
        F.struct((F.col("pos") + 2).alias("seq"), F.lit("qa").alias("type"), qa_text(F.col("query"), F.col("answer")).alias("text")))).alias("r"))
    rows = rows.select("memory_key", F.col("r.seq").cast("long").alias("seq"), "r.type", "r.text")
    return rows.withColumn("vec", emb.vector(F.col("text")))
