"""Segmentation and adaptive semantic chunking.

Plan of :func:`semantic_chunks`: a map-only job, no exchange. A transcript is one input
row; its segments are split, embedded, compared with their neighbours, folded into chunks
and the chunk texts assembled inside that row, so the work spreads over the scan's
partitions and nothing is shuffled. Segment vectors stay in the Python worker, a few thousand at
a time; the JVM gets one similarity per segment.

Why a fold over scalars is exact: the open chunk always ends with the previous segment, so
the similarity tested is that of neighbours, and the threshold is the population std of the
neighbour similarities inside the open chunk; the merged length is the sum of collapsed
segment lengths plus separators. The state is therefore (count, k, sum, sum of squares,
length, last threshold) plus the closed chunks. A transcript is one row of the input, so
its per-task arrays are bounded by one transcript, never by the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions import text as tx
from tessera.operators.embedding import DEFAULT_EMBEDDER, neighbour_sims

CHUNK_TYPE = "semantic_dynamic"
_CLOSED = "array<struct<start:int,cnt:int,len:int,thr:double>>"


def segment_transcripts(transcripts: DataFrame) -> DataFrame:
    """B1 as rows: (task_id, seg_no, text, n_chars)."""
    segs = transcripts.select("task_id", F.posexplode(tx.split_segments("text")).alias("seg_no", "text"))
    return segs.withColumn("seg_no", F.col("seg_no").cast("long")).withColumn("n_chars", F.length("text").cast("long"))


def _fold(sims: list[float | None], clens: list[int], base: float, max_chars: int) -> list[tuple[int, int, int, float]]:
    """Left-to-right chunk fold of one transcript: (start, cnt, len, thr) of every chunk.

    D1 from running sums: base if the open chunk has fewer than two segments, else clamp(base - 0.1 * std, 0.3, 0.9).
    """
    out, start, cnt, s1, s2, size, thr = [], 0, 1, 0.0, 0.0, clens[0] if clens else 0, base
    for i in range(1, len(clens)):
        sim, thr = sims[i], base
        if cnt > 1:
            mean = s1 / (cnt - 1)
            var = s2 / (cnt - 1) - mean * mean
            thr = max(0.3, min(0.9, base - 0.1 * math.sqrt(max(0.0, var)))) if var == var else 0.9  # NaN as in SQL
        if sim is not None and not sim <= thr and size + 1 + clens[i] <= max_chars:
            cnt, s1, s2, size = cnt + 1, s1 + sim, s2 + sim * sim, size + 1 + clens[i]
        else:
            out.append((start, cnt, size, thr))
            start, cnt, s1, s2, size = i, 1, 0.0, 0.0, clens[i]
    if clens:
        out.append((start, cnt, size, thr))  # the last chunk records the threshold of the last step
    return out


def _closed_lists(sims: pa.ListArray, clens: pa.ListArray, base: float, max_chars: int) -> pa.ListArray:
    """The fold of some transcripts, one after the other."""
    closed, ends = [], [0]
    for s, lens in zip(sims, clens):
        closed += _fold(s.as_py() or [], lens.as_py() or [], base, max_chars)
        ends.append(len(closed))
    cols = zip(*closed) if closed else [[]] * 4
    items = pa.StructArray.from_arrays(
        [pa.array(c, type=t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.float64()))],
        names=["start", "cnt", "len", "thr"])
    return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), items)


def fold_chunks(segs, clens, emb, base: float, max_chars: int) -> Column:
    """``array<struct<start, cnt, len, thr>>`` of a transcript's segments and collapsed lengths (empty if null).

    Similarities and fold run in one Python worker per task: beside its Arrow batch it holds some
    thousand vectors and the chunks of as many segments, or of one longer transcript.
    """
    fold, mk = _closed_lists, emb.list_sims

    @F.arrow_udf(_CLOSED)
    def _chunks(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        sims = mk()
        for texts, lens in batches:
            at = 0
            for part in sims(texts):
                yield fold(part, lens.slice(at, len(part)), base, max_chars)
                at += len(part)

    return _chunks(segs, clens)


def _per_task_segments(transcripts: DataFrame) -> DataFrame:
    """(task_id, segs array<string>, clens array<int>), computed in-row: no exchange."""
    t = transcripts.select("task_id", tx.split_segments("text").alias("segs"))
    return t.withColumn("clens", F.transform("segs", lambda s: F.length(tx.collapse_ws(s))))


def semantic_chunks(transcripts: DataFrame, cfg: Settings = Settings(), embedder=None) -> DataFrame:
    """Chunks with metadata, for every transcript at once.

    Columns: task_id, chunk_id, chunk_index, chunk_type, seg_start, segment_count, word_count,
    character_count, similarity_threshold_used, source, content, created_at.
    """
    closed = fold_chunks(F.col("segs"), F.col("clens"), embedder or DEFAULT_EMBEDDER, cfg.base_threshold, cfg.max_chunk_chars)
    pt = _per_task_segments(transcripts).select("task_id", "segs", closed.alias("_closed"))
    kept = F.filter("_closed", lambda c: c["len"] >= F.lit(cfg.min_chunk_chars))
    ex = pt.select("task_id", "segs", F.posexplode(kept).alias("chunk_index", "c"))
    content = tx.merge_text(F.slice(F.col("segs"), F.col("c.start") + 1, F.col("c.cnt")))
    out = ex.select(
        "task_id",
        F.concat(F.col("task_id"), F.lit("_semantic_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.lit(CHUNK_TYPE).alias("chunk_type"),
        F.col("c.start").cast("long").alias("seg_start"),
        F.col("c.cnt").cast("long").alias("segment_count"),
        content.alias("content"),
        F.col("c.thr").alias("similarity_threshold_used"),
        F.lit("transcript").alias("source"),
    )
    return (out.withColumn("word_count", tx.word_count("content").cast("long"))
            .withColumn("character_count", F.length("content").cast("long"))
            .withColumn("created_at", F.current_timestamp()))


def segment_similarities(transcripts: DataFrame, cfg: Settings = Settings(), embedder=None) -> DataFrame:
    """C6 in the chunking plan: (task_id, seg_no, sim_prev, clen) per segment."""
    pt = _per_task_segments(transcripts).withColumn("sims", neighbour_sims("segs", embedder or DEFAULT_EMBEDDER))
    st = pt.select("task_id", F.posexplode(F.arrays_zip("sims", "clens")).alias("seg_no", "s"))
    return st.select("task_id", F.col("seg_no").cast("long").alias("seg_no"), F.col("s.sims").alias("sim_prev"),
                     F.col("s.clens").cast("long").alias("clen"))


def adaptive_threshold(sims: DataFrame, base: float = Settings().base_threshold, by: str = "task_id",
                       sim_col: str = "sim_prev") -> DataFrame:
    """D1 standalone: per group, base if fewer than two values, else clamp(base - 0.1 * std_pop)."""
    g = sims.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count(sim_col).alias("n_sims"),
                             F.stddev_pop(sim_col).alias("std"))
    thr = F.when(F.col("n") < 2, F.lit(base)).otherwise(
        F.greatest(F.lit(0.3), F.least(F.lit(0.9), F.lit(base) - F.lit(0.1) * F.coalesce(F.col("std"), F.lit(0.0)))))
    return g.select(by, F.col("n").cast("long").alias("n_segments"), thr.alias("threshold"))


def chunk_stats(chunks: DataFrame, by: str | None = "task_id", base: float = Settings().base_threshold) -> DataFrame:
    """D3: total, mean/min/max words, mean segments per chunk, strategy, base threshold."""
    aggs = [F.count(F.lit(1)).cast("long").alias("total_chunks"),
            F.avg("word_count").alias("avg_chunk_size_words"),
            F.min("word_count").cast("long").alias("min_chunk_size_words"),
            F.max("word_count").cast("long").alias("max_chunk_size_words"),
            F.avg("segment_count").alias("avg_segments_per_chunk")]
    g = chunks.groupBy(by).agg(*aggs) if by else chunks.agg(*aggs)
    return g.withColumn("chunking_strategy", F.lit(CHUNK_TYPE)).withColumn("base_similarity_threshold", F.lit(base))
