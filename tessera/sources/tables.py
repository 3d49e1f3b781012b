"""Driver tables bound to the engine's schemas (the same bindings as the SQL twins).

* ``transcripts``: documents, ``task_id = 'doc_' || doc_id``.
* ``vectors``: every embeddings row is a stored vector, ``task_id = 't' || (vec_id % 5)``,
  ``chunk_id = 'c' || vec_id``, ``content = 'vec ' || vec_id``, vector as ``array<double>``.
* ``vector_queries``: every embeddings row is also a query against its task
  (``query_id = vec_id``), so retrieval runs over the whole table in both roles.
* ``members``: ``cluster_id = label``.
* ``text_queries``: benchmark, ``query_id = item_id``, ``task_id = 'all'``.
* ``messages``: conversations as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_TASKS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a source that scans as fewer partitions than the cluster has cores.

    A single large file with one row group scans as one task, and all per-row text work after
    it would run on one core. Only then is it worth a round-robin exchange of the raw rows; a
    source that already scans wide (the normal case on a cluster) is returned untouched, so
    no exchange is added at scale.
    """
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"))
    return d.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("task_id"), "text", "lang")


def _vec_task():
    return F.concat(F.lit("t"), (F.col("vec_id") % N_TASKS).cast("string"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        _vec_task().alias("task_id"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("chunk_id"),
        F.concat(F.lit("vec "), F.col("vec_id").cast("string")).alias("content"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("long").alias("query_id"), _vec_task().alias("task_id"),
                    F.col("embedding").cast("array<double>").alias("qvec"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(_vec_task().alias("task_id"), F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("chunk_id"),
                    F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("cluster_id"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").cast("long").alias("query_id"), F.lit("all").alias("task_id"),
                    F.col("text").alias("query"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(table(spark, sf_dir, "conversations"))
    return c.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                    "role", "text")


def turn_id(conv: str, turn: str):
    """One LONG for (conversation, turn) of the driver's table; turns stay below 2**32."""
    return F.col(conv) * (1 << 32) + F.col(turn)


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions from conversations: every user turn, with the next assistant turn as its answer.

    query_id = conv_id * 2**32 + turn (turns below 2**32), task_id = 'all', memory_key = 'm' || (conv_id % 10).
    ``pos`` = 2 * (position of the turn within its key, ordered by (conv_id, turn)), numbered
    with range partitions and per-piece offsets, so no window sorts a whole key.
    """
    from tessera.operators.ordering import positions

    m = messages(spark, sf_dir)
    ans = m.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                         F.col("text").alias("answer"))
    u = (m.filter(F.col("role") == "user").join(ans, ["conv_id", "turn"], "left")
         .select("conv_id", "turn", F.col("text").alias("query"), F.coalesce("answer", F.lit("")).alias("answer"),
                 F.concat(F.lit("m"), (F.col("conv_id") % 10).cast("string")).alias("memory_key")))
    u = positions(u, "memory_key", ["conv_id", "turn"], "_j")
    return u.select(turn_id("conv_id", "turn").alias("query_id"), F.lit("all").alias("task_id"),
                    "memory_key", (F.col("_j") * 2).cast("long").alias("pos"), "conv_id", "turn", "query", "answer")


def given_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, answer): the assistant's turn after each user turn."""
    m = messages(spark, sf_dir).filter(F.col("role") == "assistant")
    return m.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))


def first_memory(spark: SparkSession) -> DataFrame:
    """The memory that task ``all`` begins with: an empty ingest summary at seq 0."""
    return spark.createDataFrame([("all", 0, "ingest_summary", "", None)],
                                 "memory_key string, seq long, type string, text string, vec array<double>")


def _first_letters_word(c):
    return F.regexp_replace(F.element_at(F.split(c, " "), 1), "[^A-Za-z]", "")


def grade_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grader outputs built from conversations (request_id = conv_id), one JSON item per turn.

    Shape by conv_id % 5: fenced array; bare array; array in chatter; broken JSON; array with
    non-object elements. Every third turn carries a grade that is not a number.
    """
    m = messages(spark, sf_dir)
    grade = F.when(F.col("turn") % 3 == 2, F.lit('"n/a"')).otherwise(
        F.format_string("%.2f", (F.length("text") % 150) / 100.0))
    item = F.concat(F.lit('{"chunk_id": "c'), F.col("turn").cast("string"), F.lit('", "grade": '), grade,
                    F.lit(', "reason": "'), _first_letters_word(F.col("text")), F.lit('"}'))
    per = (m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))).alias("_s"))
           .select("conv_id", F.concat(F.lit("["), F.array_join(F.transform("_s", lambda s: s["i"]), ", "),
                                       F.lit("]")).alias("arr")))
    shape = F.col("conv_id") % 5
    text = (F.when(shape == 0, F.concat(F.lit("```json\n"), F.col("arr"), F.lit("\n```")))
            .when(shape == 1, F.col("arr"))
            .when(shape == 2, F.concat(F.lit("Here are the grades: "), F.col("arr"), F.lit(" Hope this helps."),
                                       F.when(F.col("conv_id") % 2 == 0, F.lit(" See also [1].")).otherwise(F.lit(""))))
            .when(shape == 3, F.expr("substring(arr, 1, length(arr) - 1)"))
            .otherwise(F.concat(F.lit('[7, "text", '), F.expr("substring(arr, 2)"))))
    return per.select(F.col("conv_id").alias("request_id"), F.lit("grade").alias("stage"), text.alias("text"),
                      F.lit(None).cast("string").alias("error"))


def rewrite_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewriter outputs built from conversations (request_id = conv_id), shaped by conv_id % 5."""
    m = messages(spark, sf_dir)
    per = m.groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") == 0, _first_letters_word(F.col("text")))).alias("w1"),
        F.max(F.when(F.col("turn") == 1, _first_letters_word(F.col("text")))).alias("w2"),
        F.count(F.lit(1)).alias("n"))
    w1, w2 = F.coalesce("w1", F.lit("")), F.coalesce("w2", F.lit(""))
    arr = F.concat(F.lit('["'), w1, F.lit(" "), w2, F.lit('", "'), w2, F.lit('", '), F.col("n").cast("string"), F.lit("]"))
    shape = F.col("conv_id") % 5
    text = (F.when(shape == 0, F.concat(F.lit("```json\n"), arr, F.lit("\n```")))
            .when(shape == 1, arr)
            .when(shape == 2, F.when(F.col("conv_id") % 2 == 0, F.concat(arr, F.lit(" Hope this helps.")))
                  .otherwise(F.concat(F.lit("Sure! "), arr)))
            .when(shape == 3, F.concat(F.lit('["'), w1))
            .otherwise(F.concat(F.lit('[{"x": 1}, '), F.when(F.col("conv_id") % 2 == 0, F.lit("true, ")).otherwise(F.lit("")),
                                F.col("conv_id").cast("string"), F.lit(', "'), w1, F.lit('"]'))))
    return per.select(F.col("conv_id").alias("request_id"), F.lit("rewrite").alias("stage"), text.alias("text"),
                      F.lit(None).cast("string").alias("error"))


def route_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Router outputs per conversation: 'RAG', 'NORMAL', '`RAG`', 'RAG or NORMAL', '' by conv_id % 5."""
    c = messages(spark, sf_dir).select("conv_id").distinct()
    shape = F.col("conv_id") % 5
    text = (F.when(shape == 0, F.lit("RAG")).when(shape == 1, F.lit("NORMAL")).when(shape == 2, F.lit("`RAG`"))
            .when(shape == 3, F.lit("RAG or NORMAL")).otherwise(F.lit("")))
    return c.select(F.col("conv_id").alias("request_id"), F.lit("route").alias("stage"), text.alias("text"),
                    F.lit(None).cast("string").alias("error"))


def routing_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User messages with chat flags from conv_id % 11 (chat_only 0; force_rag 1 and 4; no
    auto-retrieve 2; no task 3 and 4)."""
    m = messages(spark, sf_dir).filter(F.col("role") == "user")
    r = F.col("conv_id") % 11
    return m.select("conv_id", "turn", "role", "text", (r == 0).alias("chat_only"), r.isin(1, 4).alias("force_rag"),
                    (r != 2).alias("auto_retrieve"),
                    F.when(r.isin(3, 4), F.lit(None).cast("string")).otherwise(F.lit("all")).alias("task_id"))
