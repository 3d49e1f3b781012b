"""The question stream against the batch plan over all messages: memory and histories live in streaming state."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.operators import corrective as cr
from tessera.operators import embedding as em
from tessera.plans import pipelines as pl
from tessera.streaming import streams as sm

SCHEMA = "conv_id long, turn long, role string, text string, task_id string"
MEMORY = "memory_key string, seq long, type string, text string, vec array<double>"
CFG = replace(Settings(), memory_window=3)
SAID = ["when did the speaker open the harbour", "thanks, that helps", "where is the harbour bridge", "who built the harbour bridge",
        "tell me a joke", "what details of the bridge are known", None]


@pytest.fixture(scope="module")
def messages(spark):
    rows = []
    for conv in range(6):
        task = {4: None, 5: "b"}.get(conv, "a")
        for turn in range(10):  # longer than a chat history
            k = (conv * 3 + turn // 2) % len(SAID)
            rows.append((conv, turn, "user", SAID[k], task) if turn % 2 == 0 else
                        (conv, turn, None if turn == 3 else "assistant", f"answer {conv} {turn} on the harbour", task))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def store(spark):
    texts = ["the harbour was opened in spring", "the bridge of the harbour is long", "the speaker talks about bread",
             "details of the bridge are exact", "a joke about bread", "who built it is unknown"]
    df = spark.createDataFrame([(t, i, f"{t}_{i}", x, i % 2) for t in "ab" for i, x in enumerate(texts)],
                               "task_id string, vec_id long, chunk_id string, content string, cluster_id int")
    return df.withColumn("vec", em.DEFAULT_EMBEDDER.vector(F.col("content"))).cache()


@pytest.fixture(scope="module")
def memory(spark):
    m = spark.createDataFrame([("a", i, "qa", f"Q: where is bridge {i}\nA: in the harbour") for i in range(5)] +
                              [("c", 0, "ingest_summary", "")], "memory_key string, seq long, type string, text string")
    return m.withColumn("vec", F.when(F.col("type") == "qa", em.DEFAULT_EMBEDDER.vector(F.col("text")))).cache()


def answers_of(messages):
    return (messages.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")))


def stream(spark, src, base, messages, store, memory, grader=None):
    q = sm.question_stream(spark, f"{src}", store, store.select("task_id", "chunk_id", "cluster_id"), f"{base}/out", f"{base}/ckpt", CFG,
                           schema=SCHEMA, route_flags={"chat_only": False, "force_rag": False, "auto_retrieve": True},
                           memory=memory, answers=answers_of(messages), max_files=1, grader=grader)
    q.awaitTermination()
    turns = {(r.conv_id, r.turn): (r.mode_used, r.reason, r.prompt) for r in spark.read.parquet(f"{base}/out/turns").collect()}
    entries = sorted((r.memory_key, r.seq, r.type, r.text) for r in spark.read.parquet(f"{base}/out/memory").collect())
    return turns, entries


def batch(messages, store, memory, grader=None):
    flagged = (messages.withColumn("chat_only", F.lit(False)).withColumn("force_rag", F.lit(False)).withColumn("auto_retrieve", F.lit(True)))
    out = pl.chat_session(flagged, store, store.select("task_id", "chunk_id", "cluster_id"), CFG, memory=memory, use_memory=True,
                          answers=answers_of(messages), grader=grader)
    turns = {(r.conv_id, r.turn): (r.mode_used, r.reason, r.prompt) for r in out.turns.collect()}
    return turns, sorted((r.memory_key, r.seq, r.type, r.text) for r in out.memory_rows.collect())


def test_three_batches_and_a_restart_equal_one_batch(spark, messages, store, memory, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        grader = lambda q, s: cr.lexical_grades(q, s)
        src = tmp_path / "in"
        for part in range(2):
            messages.filter(F.floor(F.col("conv_id") / 2) == part).coalesce(1).write.mode("append").parquet(str(src))
        first, _ = stream(spark, src, tmp_path, messages, store, memory, grader)
        assert {c for c, _ in first} == {0, 1, 2, 3}
        messages.filter("conv_id >= 4").coalesce(1).write.mode("append").parquet(str(src))
        turns, entries = stream(spark, src, tmp_path, messages, store, memory, grader)  # goes on from its checkpoint
        want, rows = batch(messages, store, memory, grader)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert turns == want and len(turns) == 30
    assert entries == rows
    assert {e[0] for e in entries} == {"a", "b"}
    assert [e[1] for e in entries if e[0] == "a"] == list(range(5, 5 + sum(e[0] == "a" for e in entries)))  # goes on after the first memory
    assert any("harbour" in (p or "") for m, _, p in turns.values() if m == "rag")


def test_tails_keep_order_and_bound():
    """The processors without a cluster: rows of several frames, ordered, tails bounded."""
    import pandas as pd

    from tessera.streaming.state import ConversationTail, MemoryTail

    class Tail:
        def __init__(self):
            self.rows = []

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

    class Handle:
        def getListState(self, name, schema):
            return Tail()

    c = ConversationTail(2, ["mode"])
    c.init(Handle())
    rows = pd.DataFrame([(1, 2, "user", "third", "chat"), (1, 0, "user", "first", "chat"), (1, 1, "assistant", None, "chat"),
                         (1, 3, None, "fourth", "chat"), (1, 4, "user", "fifth", "chat")],
                        columns=["conv_id", "turn", "role", "text", "mode"])
    out = pd.concat(c.handleInputRows((1,), iter([rows[:2], rows[2:]]), None))
    assert [[h["text"] for h in r] for r in out["history"]] == [[], ["first", ""], ["third", "fourth"]]
    assert [t[0] for t in c.tail.rows] == [3, 4]

    m = MemoryTail(3, ["text", "mode"])
    m.init(Handle())
    first = pd.DataFrame([(2, "qa", "x", [1.0]), (0, "query", "y", None)], columns=["seq", "type", "text", "vec"])
    m.handleInitialState(("k",), first, None)
    rows = pd.DataFrame([(1, 2, "b", "rag", [2.0], "QB", [3.0]), (1, 0, "a", "rag", [4.0], "QA", [5.0]), (1, 1, "c", "chat", [0.0], "", [0.0])],
                        columns=["conv_id", "turn", "text", "mode", "query_vec", "qa_text", "qa_vec"])
    out = pd.concat(m.handleInputRows(("k",), iter([rows]), None))
    assert out["pos"].tolist() == [2, -1, 4]
    assert [[e["seq"] for e in w] for w in out["window"]] == [[0, 2], [], [2, 3, 4]]
    assert [(e[0], e[1]) for e in m.tail.rows] == [(4, "qa"), (5, "query"), (6, "qa")]
