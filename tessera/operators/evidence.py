"""Evidence, prompts and digests (H1-H9).

Prompts are rows: model calls are table boundaries. A prompt table leaves the engine, a
completions table (request_id, stage, text, error) comes back and is joined on its key.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import CHAT_HISTORY, MAX_EVIDENCE_CHARS
from tessera.functions import text as tx

# Prompt texts.
EVIDENCE_HEADER = "Retrieved evidence:\n"
QUESTION_HEADER = "User question:\n"
DIGEST_EVIDENCE_PROMPT = (
    "Summarize the following retrieved evidence into a concise digest that preserves key facts and names.\n"
    "Use bullet points where appropriate, keep it under 500 words.\n\n"
)
DIGEST_TRANSCRIPT_SYSTEM = (
    "You are a helpful assistant specialized in summarizing YouTube video transcripts that are generated by "
    "whisper model."
)
DIGEST_TRANSCRIPT_HEAD = (
    "Given the transcript of a YouTube video, your task is to generate a straight to point and informative "
    "summary. \n\n"
    "             The summary should cover key points, main ideas, and critical information, organized in a "
    "coherent and structured way. \n\n"
    "              Ensure that the summary is not exceed 1000 words.\n\n"
    "             Make sure that the summary retains the flow and structure of the original transcript while "
    "omitting unnecessary details. \n\n"
    "              The summary should be easy to follow, informative, and structured, highlighting important "
    "tips, steps, or insights provided in the transcript.\n"
    "            \n\nTranscript:  "
)
DIGEST_TRANSCRIPT_TAIL = " "
CHAT_PROMPT_HEAD = ("You are a helpful and concise assistant. Answer naturally based on the ongoing conversation.\n"
                    "Conversation so far:\n")


def _fmt2(c) -> Column:
    return F.format_string("%.2f", c)


def evidence_lines(graded: DataFrame, id_col: str = "chunk_id", score_col: str = "score",
                   grade_col: str = "grade", cluster_col: str = "cluster_id", text_col: str = "content") -> DataFrame:
    """H1: ``[id] (grade 0.00, sim 0.00, cl c) text``; the grade part only when a grade exists.

    A null cluster prints ``-``.
    """
    cl = F.coalesce(F.col(cluster_col).cast("string"), F.lit("-"))
    has_grade = F.col(grade_col).isNotNull() if grade_col in graded.columns else F.lit(False)
    grade_part = (F.concat(F.lit("grade "), _fmt2(F.col(grade_col)), F.lit(", "))
                  if grade_col in graded.columns else F.lit(""))
    line = F.concat(F.lit("["), F.coalesce(F.col(id_col), F.lit("")), F.lit("] ("),
                    F.when(has_grade, grade_part).otherwise(F.lit("")),
                    F.lit("sim "), _fmt2(F.coalesce(F.col(score_col), F.lit(0.0))), F.lit(", cl "), cl, F.lit(") "),
                    F.coalesce(F.col(text_col), F.lit("")))
    return graded.withColumn("line", line)


#: Words of a piece at most; a longer sentence is cut into several.
DIGEST_PIECE_WORDS = 30
#: Rows whose pieces are weighed at a time.
DIGEST_ROWS = 32


def digest_pieces(line) -> Column:
    """What a digest is chosen from: the sentences of a line, long ones in pieces, their words one blank apart."""
    n = DIGEST_PIECE_WORDS
    cut = lambda words: F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / n)),
                                    lambda i: F.array_join(F.slice(words, (i * n + 1).cast("int"), n), " "))
    return F.flatten(F.transform(tx.split_segments(line), lambda s: cut(F.split(s, r"\s+", -1))))


def choose_pieces(pieces: list[str], words: list[list[str]], max_chars: int) -> str:
    """The pieces, in their order and one per line, that a budget of ``max_chars`` covers best.

    Greedy choice for a submodular gain: a piece is worth the words that no chosen piece has, each weighted by
    1000 * pieces // pieces with it, per character. Gains only fall as pieces are chosen, so only the
    best candidate is weighed again (lazy greedy). Ties go to the earlier piece; what does not fit or adds no
    word is passed over.
    """
    own = [dict.fromkeys(w) for w in words]
    in_pieces = Counter(w for ws in own for w in ws)
    weight = {w: 1000 * len(pieces) // n for w, n in in_pieces.items()}
    covered, chosen, left = set(), [], max_chars + 1  # every piece but the last takes a line break along

    def worth(i):
        return sum(weight[w] for w in own[i] if w not in covered) * 1_000_000 // len(pieces[i])

    heap = [(-worth(i), i) for i in range(len(pieces))]
    heapq.heapify(heap)
    while heap:
        _, i = heapq.heappop(heap)
        if len(pieces[i]) + 1 > left:
            continue
        now = (-worth(i), i)
        if heap and now > heap[0]:
            heapq.heappush(heap, now)
        elif now[0] < 0:
            chosen.append(i)
            covered.update(own[i])
            left -= len(pieces[i]) + 1
    return "\n".join(pieces[i] for i in sorted(chosen))


def _digests(batches, max_chars: int):
    """Digests of (pieces, words); words as Python strings are many times their text, so a few rows at a time."""
    for ps, ws in batches:
        for s in range(0, len(ps), DIGEST_ROWS):
            yield pa.array([None if p is None else choose_pieces(p, w, max_chars) for p, w in
                            zip(ps.slice(s, DIGEST_ROWS).to_pylist(), ws.slice(s, DIGEST_ROWS).to_pylist())], pa.string())


def with_digest(rows: DataFrame, lines: Column, out: str, max_chars: int) -> DataFrame:
    """``rows`` with the digest of an ordered array of lines; null for null. Every sentence of every line is weighed."""
    from tessera.operators.corrective import words_of

    pieces = F.flatten(F.transform(lines, digest_pieces))
    d = rows.withColumn("_pieces", pieces).withColumn("_words", F.transform("_pieces", words_of))

    @F.arrow_udf(T.StringType())
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return _digests(batches, max_chars)

    return d.withColumn(out, run("_pieces", "_words")).drop("_pieces", "_words")


def evidence_text(lines: DataFrame, by: str = "query_id", order: str = "ord",
                  max_chars: int = MAX_EVIDENCE_CHARS) -> DataFrame:
    """H2: ordered lines joined by new lines per query; over budget -> flagged for a digest.

    ``evidence_cut`` is the original's fallback for a failed digest (the first ``max_chars``);
    ``evidence_digest`` our offline stand-in for the digest itself: over budget, the sentences of all lines
    that cover most of their words, weighted by rarity, within the budget (:func:`choose_pieces`).
    If no sentence fits, it is ``evidence_cut``.

    One query's lines are at most k (or the merged hits of a few searches), so the ordered
    collect is bounded by the retrieval fan-in, not by the data.
    """
    agg = lines.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("line").alias("l"))))
                                .alias("_l"))
    agg = agg.select(by, F.col("_l.l").alias("_l")).withColumn("evidence", F.array_join("_l", "\n"))
    over = F.length("evidence") > F.lit(max_chars)
    return (with_digest(agg.withColumn("_l", F.when(over, F.col("_l"))), F.col("_l"), "_short", max_chars).drop("_l")
            .withColumn("evidence_chars", F.length("evidence").cast("long"))
            .withColumn("needs_digest", F.col("evidence_chars") > F.lit(max_chars))
            .withColumn("evidence_cut", F.substring("evidence", 1, max_chars))
            .withColumn("evidence_digest", F.when(~F.col("needs_digest"), F.col("evidence"))
                        .otherwise(F.coalesce(F.nullif("_short", F.lit("")), F.col("evidence_cut"))))
            .drop("_short"))


def answer_prompts(queries: DataFrame, evidence: DataFrame, by: str = "query_id", query_col: str = "query",
                   evidence_col: str = "evidence") -> DataFrame:
    """H3: evidence block, then the question block (parts joined by new lines)."""
    j = queries.join(evidence.select(by, evidence_col), by, "left")
    ev = F.coalesce(F.col(evidence_col), F.lit(""))
    prompt = F.concat(F.lit(EVIDENCE_HEADER), F.lit("\n"), ev, F.lit("\n"), F.lit("\n"), F.lit(QUESTION_HEADER),
                      F.col(query_col), F.lit("\n"))
    return j.withColumn("prompt", prompt)


def chat_prompt(history: Column, text: Column) -> Column:
    """The prompt of one user message after its history, an ordered array of (role, text)."""
    said = F.array_join(F.transform(history, lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n")
    return F.concat(F.lit(CHAT_PROMPT_HEAD), said, F.lit("\n\n"), F.lit("User: "), text, F.lit("\nAssistant:"))


def chat_prompts(messages: DataFrame, max_history: int = CHAT_HISTORY) -> DataFrame:
    """H4: per user turn, the last ``max_history`` earlier messages as ``role: content``, then the new one.

    The history goes by place, not by turn number (turns may have gaps): messages are numbered
    densely per conversation and the history is an equi-join on (conv_id, place - n) for n in
    1..max_history, so even a very long conversation is never sorted in one task; the per-turn
    collect is bounded by ``max_history``.
    """
    from tessera.operators.ordering import positions

    messages = positions(messages, "conv_id", ["turn"], "_place")
    hist = messages.select("conv_id", F.col("_place").alias("_t"),
                           F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("user")).alias("role"),
                                    F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("_m"))
    users = messages.filter(F.col("role") == "user")
    back = users.select("conv_id", "turn", "_place", F.explode(F.sequence(F.lit(1), F.lit(max_history))).alias("_n"))
    back = back.select("conv_id", "turn", (F.col("_place") - F.col("_n")).alias("_t"))
    h = (back.join(hist, ["conv_id", "_t"], "inner").groupBy("conv_id", "turn")
         .agg(F.array_sort(F.collect_list("_m")).alias("_h")))
    j = users.join(h, ["conv_id", "turn"], "left")
    prompt = chat_prompt(F.coalesce(F.col("_h"), F.array().cast(h.schema["_h"].dataType)), F.col("text"))
    return j.withColumn("prompt", prompt).drop("_h", "_place")


def digest_prompts_transcripts(transcripts: DataFrame) -> DataFrame:
    """H5 (transcripts): summary prompt asking for at most 1000 words, as system and user message."""
    return (transcripts.withColumn("system", F.lit(DIGEST_TRANSCRIPT_SYSTEM))
            .withColumn("prompt", F.concat(F.lit(DIGEST_TRANSCRIPT_HEAD), F.coalesce("text", F.lit("")),
                                           F.lit(DIGEST_TRANSCRIPT_TAIL))))


def digest_prompts_evidence(evidence: DataFrame, evidence_col: str = "evidence") -> DataFrame:
    """H5 (evidence): digest prompt asking for at most 500 words."""
    return evidence.withColumn("prompt", F.concat(F.lit(DIGEST_EVIDENCE_PROMPT), F.col(evidence_col)))


def extractive_digest(segments: DataFrame, max_words: int, by: str = "task_id", order: str = "seg_no",
                      text_col: str = "text") -> DataFrame:
    """H6: offline stand-in for the summary model (not behaviour of the original, which calls a model).

    Sentences are scored by the mean TF-IDF of their words (tf within the document, idf over
    documents), the best are taken while the running word total stays within ``max_words``
    (ties by position), and printed in original order. A document none of whose best
    sentences fits has an empty digest.
    """
    words = segments.select(by, order, F.explode(F.split(F.lower(tx.strip(F.col(text_col))), r"(?U)\s+")).alias("w"))
    words = words.filter(F.col("w") != "")
    # The document count is a scalar subquery (no action on the driver, no join).
    n_docs = segments.select(by).distinct().agg(F.count(F.lit(1)).cast("double")).scalar()
    tf = words.groupBy(by, "w").agg(F.count(F.lit(1)).alias("tf"))
    df_ = tf.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    idf = df_.select("w", F.log(n_docs / F.col("df")).alias("idf"))
    # tf-idf is attached per distinct (document, word) first; occurrences then join it on
    # (document, word). Occurrences are never keyed by the word alone, so a very common word
    # does not pull all its occurrences into one task.
    tfidf = tf.join(idf, "w").select(by, "w", (F.col("tf") * F.col("idf")).alias("_v"))
    # Both sides grow with the text: a sort-merge join, never a broadcast picked from an
    # under-estimate of the exploded occurrences.
    scored = (words.hint("merge").join(tfidf, [by, "w"])
              .groupBy(by, order).agg(F.avg("_v").alias("score"), F.count(F.lit(1)).alias("n_words")))
    w = Window.partitionBy(by).orderBy(F.desc("score"), F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    picked = scored.withColumn("_run", F.sum("n_words").over(w)).filter(F.col("_run") <= max_words)
    seg = segments.select(by, order, text_col)
    said = (picked.hint("merge").join(seg, [by, order])
            .groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, text_col))).alias("_s"))
            .select(by, F.array_join(F.transform("_s", lambda s: s[text_col]), " ").alias("digest")))
    return (segments.select(by).distinct().join(said, by, "left")
            .select(by, F.coalesce("digest", F.lit("")).alias("digest")))


def ingest_summary(chunks: DataFrame, n: int = 3, cut: int = 400) -> DataFrame:
    """H7: first three chunks, ``text[:400] + '...'`` each, joined without separator."""
    first = chunks.filter(F.col("chunk_index") < n)
    return (first.groupBy("task_id")
            .agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("_c"))
            .select("task_id", F.array_join(F.transform("_c", lambda s: F.concat(F.substring(s["content"], 1, cut),
                                                                             F.lit("..."))), "").alias("text"),
                    F.lit("ingest_summary").alias("type")))


def attach_completions(prompts: DataFrame, completions: DataFrame, key: str = "request_id") -> DataFrame:
    """H9: model outputs joined to their requests; missing or failed -> empty text, error kept."""
    c = completions.select(key, F.col("text").alias("_ct"), F.col("error").alias("_ce"))
    j = prompts.join(c, key, "left")
    err = F.when(F.col("_ct").isNull() & F.col("_ce").isNull(), F.lit("missing completion")).otherwise(F.col("_ce"))
    return (j.withColumn("completion", F.when(F.col("_ce").isNull(), F.coalesce(F.col("_ct"), F.lit("")))
                         .otherwise(F.lit("")))
            .withColumn("completion_error", err).drop("_ct", "_ce"))


def retrieval_report(hits: DataFrame, n: int = 10) -> DataFrame:
    """the first ``n`` hits, one formatted line each: rank, similarity, grade (0.00 if none), index
    score, cluster (or -), id."""
    grade = F.coalesce(F.col("grade"), F.lit(0.0)) if "grade" in hits.columns else F.lit(0.0)
    line = F.concat(F.lit("  - r="), F.coalesce(F.col("rank").cast("string"), F.lit("-")),
                    F.lit(", sim="), _fmt2(F.coalesce(F.col("similarity_score"), F.lit(0.0))),
                    F.lit(", grade="), _fmt2(grade),
                    F.lit(" faiss="), _fmt2(F.coalesce(F.col("index_similarity"), F.lit(0.0))),
                    F.lit(", cl="), F.coalesce(F.col("cluster_id").cast("string"), F.lit("-")),
                    F.lit(" id="), F.coalesce(F.col("chunk_id"), F.lit("")))
    return hits.filter(F.col("rank") <= n).withColumn("report_line", line)
