"""Numbering, composite keys, stored deletion and strict parsing beyond the sizes of the driver tables."""

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.operators import corrective as cr
from tessera.operators import evidence as ev
from tessera.operators import memory as mm
from tessera.operators import retrieval as rt
from tessera.operators.ordering import positions
from tessera.plans import pipelines as pl
from tessera.sources import files as fl
from tessera.sources import store as st


@pytest.mark.parametrize("n,n_parts,aqe", [(100_000, None, True), (100_000, 16, False), (100_000, 5, True),
                                           (1_000_000, None, True)])
def test_positions_with_payload_equal_row_number(spark, n, n_parts, aqe):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", str(aqe).lower())
    try:
        df = spark.range(0, n, 1, 8).select(
            F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 5).cast("string"))).alias("key"),
            F.xxhash64("id").alias("o"), F.col("id").alias("o2"), F.repeat(F.lit("payload "), 6).alias("text"))
        got = positions(df, "key", ["o", "o2"], "pos", n_parts)
        per = got.groupBy("key").agg(F.count("*").alias("c"), F.min("pos").alias("lo"), F.max("pos").alias("hi"),
                                     F.countDistinct("pos").alias("d")).collect()
        assert sum(r.c for r in per) == n
        assert all(r.lo == 0 and r.hi == r.c - 1 and r.d == r.c for r in per)
        if n <= 100_000:
            from pyspark.sql import Window
            want = df.withColumn("w", F.row_number().over(Window.partitionBy("key").orderBy("o", "o2")) - 1)
            assert got.join(want.select("key", "o2", "w"), ["key", "o2"]).filter("pos <> w").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def tiny_store(spark, n=30, dim=8):
    rng = np.random.default_rng(0)
    rows = [("all", i, f"c{i}", f"text {i}", [float(x) for x in rng.normal(size=dim)]) for i in range(n)]
    return spark.createDataFrame(rows, "task_id string, vec_id long, chunk_id string, content string, vec array<double>")


class Fixed:
    """Embedder of fixed random vectors by text."""
    name = "fixed"

    def vector(self, c):
        return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.pmod(F.xxhash64(c, i), F.lit(2001)) - 1000) / 500.0)

    def embed(self, df, text, keys, out):
        return df.select(*keys, self.vector(F.col(text)).alias(out))


def test_many_memory_picks_and_large_ids_stay_with_their_question(spark):
    cfg = Settings(memory_top_n=12, memory_min_similarity=0.0, memory_window=20)
    ids = [9007199254740993, 900719925474099301, 3]
    q = spark.createDataFrame([(i, "all", "m", 15, f"question {i}") for i in ids],
                              "query_id long, task_id string, memory_key string, pos long, query string")
    emb = Fixed()
    mem = (spark.createDataFrame([("m", s, "query", f"earlier question {s}") for s in range(16)],
                                 "memory_key string, seq long, type string, text string")
           .withColumn("vec", emb.vector(F.col("text"))))
    out = pl.answer_queries(q, tiny_store(spark), None, mem, cfg, embedder=emb, k=4, threshold=0.0)
    assert {r.query_id for r in out.provenance.select("query_id").distinct().collect()} == set(ids)
    assert all("text" in r.prompt.split("User question")[0] for r in out.prompts.collect())
    qv = emb.embed(q, "query", ["query_id", "task_id", "memory_key", "pos", "query"], "qvec")
    cands = mm.memory_candidates(qv, mem, cfg)
    hits = mm.subquery_retrieve(cands, q, tiny_store(spark), None, cfg, k=4, threshold=0.0, embedder=emb)
    per = {(r.query_id, r.pick) for r in hits.collect()}
    n = {r.query_id: r["count"] for r in cands.groupBy("query_id").count().collect()}
    assert {i for i, _ in per} == set(ids) and all(len([p for i, p in per if i == x]) == n[x] > 2 for x in ids)


def test_long_conversations_and_turn_gaps(spark):
    msgs = [Row(conv_id=1, turn=t, role="user" if t % 2 == 0 else "assistant", text=f"t{t} what video", chat_only=True,
                force_rag=False, auto_retrieve=True, task_id=None) for t in range(150)]
    msgs += [Row(conv_id=2, turn=t, role="user", text=f"g{t}", chat_only=True, force_rag=False, auto_retrieve=True, task_id=None)
             for t in (0, 5, 9)]
    m = spark.createDataFrame(msgs, "conv_id long, turn long, role string, text string, chat_only boolean, force_rag boolean, "
                                    "auto_retrieve boolean, task_id string")
    got = {(r.conv_id, r.turn): r.prompt for r in pl.chat_turns(m, tiny_store(spark), None).collect()}
    assert len(got) == 78
    assert "user: g0\nuser: g5" in got[(2, 9)] and "t141" in got[(1, 148)] and "t139 " not in got[(1, 148)]
    rag = m.withColumn("chat_only", F.lit(False)).withColumn("force_rag", F.lit(True)).withColumn("task_id", F.lit("all"))
    out = pl.chat_turns(rag, tiny_store(spark), None, embedder=Fixed(), use_memory=True).collect()
    assert {(r.conv_id, r.turn) for r in out} == set(got) and all(r.mode_used == "rag" for r in out)


def test_zero_and_null_vectors(spark):
    v = spark.range(0, 5000, 1, 2).select(F.lit("t").alias("task_id"), F.col("id").alias("vec_id"),
                                          F.array(F.rand(1), F.rand(2), F.lit(1.0)).alias("vec"))
    v = v.unionByName(spark.createDataFrame([("t", 9999, None)], "task_id string, vec_id long, vec array<double>"))
    q = spark.createDataFrame([(1, "t", None), (2, "t", [0.0, 0.0, 0.0]), (3, "t", [1.0, 0.0, 0.0])],
                              "query_id long, task_id string, qvec array<double>")
    for plan in ("block", "grid"):
        hits = rt.vector_topk(q, v, k=5, strategy=plan).collect()
        assert [r.vec_id for r in sorted(hits, key=lambda r: r.rank) if r.query_id == 2] == [0, 1, 2, 3, 4]
        assert {r.query_id for r in hits} == {2, 3} and all(r.vec_id != 9999 for r in hits)
    part = rt._partial_block(*[x for x in (q.filter("query_id = 2").withColumn("k_row", F.lit(5)), v.filter("vec is not null"))],
                             5, q.filter("query_id = 2").withColumn("k_row", F.lit(5)).toPandas())
    assert part.count() <= 5 * v.rdd.getNumPartitions()


def test_ids_survive_the_store_and_deletion_is_real(spark, tmp_path):
    rows = [("007", 0, "a", "x", [1.0, 0.0]), ("08", 0, "b", "y", [0.0, 1.0]), ("b=c/d", 0, "c", "z", [1.0, 1.0])]
    v = spark.createDataFrame(rows, "task_id string, vec_id long, chunk_id string, content string, vec array<double>")
    path = st.write_chunk_store(v, str(tmp_path / "s"), v.select("task_id", F.lit(1).alias("n")))
    assert {r.task_id for r in st.load_chunk_store(spark, path).collect()} == {"007", "08", "b=c/d"}
    assert st.delete_from_store(spark, path, ["007", "b=c/d", "none"]) == {"007": True, "b=c/d": True, "none": False}
    assert [r.task_id for r in st.load_chunk_store(spark, path).collect()] == ["08"]
    assert [r.task_id for r in st.read_table(spark, path, "index_meta").collect()] == ["08"]
    t = spark.createDataFrame([("007", " seven "), ("1e3", "x")], "task_id string, text string")
    assert {(r.task_id, r.text) for r in fl.load_transcripts(spark, fl.write_transcripts(t, str(tmp_path / "t"))).collect()} == {
        ("007", "seven"), ("1e3", "x")}


def test_stored_memory_is_appended(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = lambda a, z: spark.createDataFrame([(k, i, "query", f"{k}{i}", None) for k in "ab" for i in range(a, z)],
                                              "memory_key string, ord long, type string, text string, vec array<double>")
    st.append_memory(rows(0, 3), path)
    st.append_memory(rows(3, 5), path)
    got = st.load_memory(spark, path).collect()
    assert sorted((r.memory_key, r.seq, r.text) for r in got) == [(k, i, f"{k}{i}") for k in "ab" for i in range(5)]


def test_substring_search_in_blocks(spark):
    docs = spark.createDataFrame([("a", 1, "The whole Quick brown fox"), ("a", 2, "nothing"), ("b", 3, "quick"), ("a", 4, None)],
                                 "task_id string, d long, content string")
    q = spark.createDataFrame([(1, "a", "QUICK brown"), (2, "a", ""), (3, "b", "quick"), (4, "a", None), (5, None, "x"),
                               (6, "a", "quick")], "query_id long, task_id string, query string")
    want = [(1, 1), (1, 2), (1, 6), (2, 2), (3, 3)]
    for most in (50_000, 2):
        cfg = Settings(broadcast_max_queries=most)
        assert sorted((r.d, r.query_id) for r in rt.contains_search(q, docs, cfg).collect()) == want
    plan = rt.contains_search(q, docs)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_chunk_graded_twice_counts_once(spark):
    s = spark.createDataFrame([(1, f"c{i}", i + 1) for i in range(10)], "query_id long, chunk_id string, ord long")
    g = spark.createDataFrame([(1, "c0", 0.9, 0, "first"), (1, "c0", 0.7, 1, "last"), (1, "c9", 0.8, 2, "late")],
                              "query_id long, chunk_id string, grade double, elem long, reason string")
    got = {r.chunk_id: (r.grade, r.grade_reason) for r in cr.apply_grades(s, g, 8).collect()}
    assert len(got) == 10 and got["c0"] == (0.7, "last") and got["c9"] == (0.0, "no-grade")


def test_json_must_be_whole(spark):
    texts = ['["a","b"] Hope this helps', '["a", true, 5, {"x": 1}]', '"a"] , ["b"', '["a"]', '["a"', "", '["x"]}', "[]"]
    d = spark.createDataFrame(list(enumerate(texts)), "request_id long, text string")
    got = {}
    for r in sorted(cr.parse_rewrites(d, 3).collect(), key=lambda r: r.rewrite_no):
        got.setdefault(r.request_id, []).append(r.rewrite)
    assert got == {1: ["a", "True", "5"], 3: ["a"]}
    g = spark.createDataFrame([(1, '[{"chunk_id": "a", "grade": 1}] See also [1]'), (2, 'x [{"chunk_id": "a", "grade": 1}] y')],
                              "request_id long, text string")
    assert [r.request_id for r in cr.parse_grades(g).collect()] == [2]


def test_first_failed_stage_decides(spark):
    t = spark.createDataFrame([("a",), ("b",)], "task_id string")
    c = spark.createDataFrame([("a", "x"), ("b", "y")], "task_id string, content string")
    up = spark.createDataFrame([("a", 1, "transcribe", "failed", "no speech", "E2"), ("a", 0, "download", "failed", "gone", "E1"),
                                ("b", 0, "download", "completed", "", None), ("z", 0, "download", "failed", "gone", "E1")],
                               "task_id string, stage_no int, stage string, status string, message string, error string")
    got = {r.task_id: (r.stage, r.status, r.error) for r in pl.task_status(t, c, up).collect()}
    assert got == {"a": ("download", "failed", "E1"), "b": ("index", "completed", None), "z": ("download", "failed", "E1")}


def test_digest_without_a_fitting_sentence_is_empty(spark):
    s = spark.createDataFrame([("a", 0, "one two three four five six"), ("b", 0, "short one")], "task_id string, seg_no long, text string")
    assert {r.task_id: r.digest for r in ev.extractive_digest(s, 3).collect()} == {"a": "", "b": "short one"}
