"""Properties and the behaviours of the original that are kept or fixed on purpose."""

import numpy as np
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions import text as tx
from tessera.operators import chunking as ch
from tessera.operators import corrective as cr
from tessera.operators import evidence as ev
from tessera.operators import memory as mm
from tessera.operators import retrieval as rt
from tessera.operators import routing as ro
from tessera.session import scratch_dir
from tessera.sources import files as fl
from tessera.sources import store as st
from tessera.sources import tables as tb


def test_chunks_are_long_enough_disjoint_and_ordered(spark, sf):
    c = ch.semantic_chunks(tb.transcripts(spark, sf)).collect()
    by = {}
    for r in c:
        assert r["character_count"] >= 100 and r["character_count"] == len(r["content"])
        by.setdefault(r["task_id"], []).append((r["chunk_index"], r["seg_start"], r["segment_count"]))
    for rows in by.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(len(rows)))
        for a, b in zip(rows, rows[1:]):
            assert a[1] + a[2] <= b[1]


def test_single_long_segment_gives_one_chunk_with_base_threshold(spark):
    text = "word " * 40  # one segment, 199 characters
    t = spark.createDataFrame([("x", text)], "task_id string, text string")
    rows = ch.semantic_chunks(t).collect()
    assert len(rows) == 1 and rows[0]["similarity_threshold_used"] == Settings().base_threshold


def test_short_chunks_are_dropped_and_indices_count_kept_ones(spark):
    text = "Tiny. " + "Zebra quantum xylophone " * 10 + ". Another tiny one."
    t = spark.createDataFrame([("x", text)], "task_id string, text string")
    rows = ch.semantic_chunks(t).collect()
    assert all(r["character_count"] >= 100 for r in rows)
    assert sorted(r["chunk_index"] for r in rows) == list(range(len(rows)))


def test_ranks_have_no_gaps_and_scores_in_unit_range(spark, sf):
    h = rt.search_similar(tb.vector_queries(spark, sf), tb.vectors(spark, sf), tb.members(spark, sf),
                          k=5, threshold=0.2).collect()
    by = {}
    for r in h:
        assert 0.0 <= r["similarity_score"] <= 1.0 and 0.0 <= r["index_similarity"] <= 1.0
        by.setdefault(r["query_id"], []).append(r["rank"])
    for ranks in by.values():
        assert sorted(ranks) == list(range(1, len(ranks) + 1))


def test_threshold_applies_after_the_top_k_cut(spark):
    rows = [("t", i, f"c{i}", "x", [1.0, i * 0.01]) for i in range(10)]
    v = spark.createDataFrame(rows, "task_id string, vec_id long, chunk_id string, content string, vec array<double>")
    q = spark.createDataFrame([(0, "t", [1.0, 0.0])], "query_id long, task_id string, qvec array<double>")
    assert rt.search_similar(q, v, None, k=3, threshold=0.0).count() == 3


def test_merge_keeps_best_score_first_source_on_ties_and_is_idempotent(spark):
    schema = "query_id long, chunk_id string, similarity_score double, src_ord int, rank int"
    a = spark.createDataFrame([(1, "x", 0.5, 0, 1), (1, "y", 0.4, 0, 2), (1, "", 0.9, 0, 3)], schema)
    b = spark.createDataFrame([(1, "y", 0.6, 1, 1), (1, "x", 0.5, 1, 2), (1, None, 0.9, 1, 3)], schema)
    m = mm.merge_hits(a, b).orderBy("ord").collect()
    assert [(r["chunk_id"], r["similarity_score"], r["src_ord"]) for r in m] == [("y", 0.6, 1), ("x", 0.5, 0)]
    again = mm.merge_hits(mm.merge_hits(a, b).drop("ord")).orderBy("ord").collect()
    assert [r["chunk_id"] for r in again] == [r["chunk_id"] for r in m]


def test_memory_window_never_sees_later_entries(spark, sf):
    q = tb.user_turns(spark, sf)
    from tessera.plans.catalog import memory_table

    w = mm.memory_window(q.select("query_id", "memory_key", "pos"), memory_table(spark, sf), 20)
    j = w.join(q.select("query_id", F.col("pos").alias("qpos")), "query_id")
    assert j.filter(F.col("seq") > F.col("qpos")).count() == 0
    assert j.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 20


def test_question_line(spark):
    df = spark.createDataFrame([("Q: what is it?\nA: x",), ("  q:   \nmore",), ("plain " * 50,)], "t string")
    out = [r[0] for r in df.select(tx.question_line("t")).collect()]
    assert out[0] == "what is it?" and out[1] == "  q:   \nmore" and out[2] == ("plain " * 50)[:200]


def test_null_cluster_prints_dash_and_grade_only_when_present(spark):
    df = spark.createDataFrame([("c1", 0.5, None, None, "t"), ("c2", 0.25, 0.75, 3, "u")],
                               "chunk_id string, score double, grade double, cluster_id int, content string")
    lines = [r["line"] for r in ev.evidence_lines(df).orderBy("chunk_id").collect()]
    assert lines == ["[c1] (sim 0.50, cl -) t", "[c2] (grade 0.75, sim 0.25, cl 3) u"]


def test_parse_grades_variants(spark):
    texts = [
        '```json\n[{"chunk_id": "a", "grade": 0.7, "reason": "r"}]\n```',
        'Sure: [{"chunk_id": "a", "grade": "bad"}, 3, "s", {"chunk_id": "b", "grade": 1.5}] ok',
        '[{"chunk_id": "a", "grade": 0.7}',
        'no json at all',
    ]
    c = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "request_id long, text string")
    g = {(r["request_id"], r["chunk_id"]): r["grade"] for r in cr.parse_grades(c).collect()}
    assert g == {(0, "a"): 0.7, (1, "a"): 0.0, (1, "b"): 1.0}


def test_align_grades_last_duplicate_wins_and_missing_is_no_grade(spark):
    strips = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 9)], "query_id long, chunk_id string, ord long")
    grades = spark.createDataFrame([(1, "a", 0, 0.2, "x"), (1, "a", 1, 0.9, "y"), (1, "c", 2, 0.8, "z")],
                                   "query_id long, chunk_id string, elem long, grade double, reason string")
    out = {r["chunk_id"]: (r["grade"], r["grade_reason"]) for r in cr.align_grades(strips, grades).collect()}
    assert out == {"a": (0.9, "y"), "b": (0.0, "no-grade"), "c": (0.0, "no-grade")}


def test_parse_rewrites_needs_a_bare_array(spark):
    c = spark.createDataFrame([(0, '["a", 2, {"x": 1}, "c"]'), (1, '```json\n["a"]\n```'), (2, "nope")],
                              "request_id long, text string")
    out = [(r["request_id"], r["rewrite_no"], r["rewrite"]) for r in cr.parse_rewrites(c).orderBy("request_id", "rewrite_no").collect()]
    assert out == [(0, 1, "a"), (0, 2, "2")]


def test_routing_rules_and_substring_quirk(spark):
    m = spark.createDataFrame([(1, 0, "user", "whenever you like", "t"), (1, 1, "user", "hello there", "t"),
                               (1, 2, "user", "show the video", None)],
                              "conv_id long, turn long, role string, text string, task_id string")
    r = {row["turn"]: (row["mode"], row["reason"]) for row in
         ro.route_messages(m, chat_only=False, force_rag=False, auto_retrieve=True).collect()}
    assert r[0] == ("rag", "factual signal") and r[1] == ("chat", "default chat") and r[2] == ("chat", "no task selected")


def test_parse_route(spark):
    c = spark.createDataFrame([(0, "RAG"), (1, "NORMAL"), (2, " `RAG` "), (3, "RAG or NORMAL"), (4, "")],
                              "request_id long, text string")
    out = {r["request_id"]: r["route_mode"] for r in ro.parse_route(c).collect()}
    assert out == {0: "rag", 1: "chat", 2: "rag", 3: "rag", 4: "chat"}


def test_description_dots_and_defaults(spark):
    p = spark.createDataFrame([(1, "https://a.example.org/x", "<html><title>T</title><p>hi</p></html>"),
                               (2, "nourl", "")], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in fl.video_catalog(p).collect()}
    assert out[1]["title"] == "T" and out[1]["uploader"] == "a.example.org" and out[1]["description"] == "Thi..."
    assert out[2]["title"] == "Unknown Title" and out[2]["uploader"] == "Unknown" and out[2]["description"] == ""


def test_media_files_match_the_longest_known_id(spark):
    d = scratch_dir(spark, "media-test")
    files = spark.createDataFrame([("ab_x.mp3", "1"), ("ab_c_y.mp3", "22")], "name string, body string")
    fl.write_named_files(files, d, "name", "body").count()
    ids = spark.createDataFrame([("ab",), ("ab_c",)], "task_id string")
    got = {r["title"]: r["task_id"] for r in
           fl.match_media_to_tasks(fl.media_catalog(spark, d), ids).select("task_id", "title").collect()}
    assert got == {"x": "ab", "c_y": "ab_c"}


def test_delete_reports_false_for_missing_tasks(spark):
    store = spark.createDataFrame([("a", 1), ("b", 2)], "task_id string, vec_id long")
    remaining, flags = st.delete_tasks(store, spark.createDataFrame([("a",), ("zz",)], "task_id string"))
    assert {r["task_id"]: r["removed"] for r in flags.collect()} == {"a": True, "zz": False}
    assert [r["task_id"] for r in remaining.collect()] == ["b"]


def test_stream_ingest_equals_batch(spark, sf):
    from tessera.streaming import streams as sm

    t = tb.transcripts(spark, sf)
    src = scratch_dir(spark, "in")
    fl.write_transcript_files(t, src)
    store = scratch_dir(spark, "st")
    sm.ingest_stream(spark, src, store, scratch_dir(spark, "ck")).awaitTermination()
    streamed = {r["task_id"]: r["n"] for r in spark.read.parquet(f"{store}/chunks").groupBy("task_id")
                .agg(F.count(F.lit(1)).alias("n")).collect()}
    batch = {r["task_id"]: r["n"] for r in ch.semantic_chunks(t).groupBy("task_id")
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert streamed == batch
    status = spark.read.parquet(f"{store}/task_status")
    assert status.count() == t.count()


def test_ingest_with_clustering_end_to_end(spark, sf):
    from tessera.plans import pipelines as pl

    out = pl.ingest(tb.transcripts(spark, sf))
    meta = {r["task_id"]: r for r in out.index_meta.collect()}
    n = {r["task_id"]: r["n"] for r in out.chunks.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(meta) == set(n)
    for t, m in meta.items():
        assert m["total_chunks"] == n[t] and m["embedding_dimension"] == 64
        if n[t] > 5:
            assert m["n_clusters"] >= 1 and -1.0 <= m["silhouette_score"] <= 1.0
        else:
            assert m["n_clusters"] == 0
    ids = out.vectors.groupBy("task_id").agg(F.min("vec_id").alias("a"), F.max("vec_id").alias("b"),
                                             F.count(F.lit(1)).alias("n")).collect()
    assert all(r["a"] == 0 and r["b"] == r["n"] - 1 for r in ids)
    assert out.memory.count() == len(n)
    status = {r["status"] for r in out.task_status.collect()}
    assert status <= {"completed", "failed"}


def test_answer_queries_corrective_mode_keeps_k_graded_strips(spark, sf):
    from tessera.operators import corrective as cr2
    from tessera.plans import catalog
    from tessera.plans import pipelines as pl

    store = catalog.corpus_store(spark, sf)
    q = tb.text_queries(spark, sf)
    out = pl.answer_queries(q, store, store.select("task_id", "chunk_id", "cluster_id"), None,
                            use_memory=False, grader=lambda qq, s: cr2.lexical_grades(qq, s))
    prov = out.provenance  # merged strips before selection
    prompts = {r["query_id"]: r["prompt"] for r in out.prompts.collect()}
    assert len(prompts) == q.count()
    for p in prompts.values():
        evidence = p.split("Retrieved evidence:\n\n", 1)[1].split("\n\nUser question:", 1)[0]
        lines = [x for x in evidence.split("\n") if x.startswith("[")]
        # the evidence is cut at 2000 characters, so only whole lines are checked
        assert len(lines) <= 5 and all("(grade " in x for x in lines[:-1])
    assert prov.count() > 0


def test_segment_longer_than_budget_stays_whole(spark):
    long_seg = "x" * 2500
    t = spark.createDataFrame([("x", "Alpha beta gamma delta epsilon. " + long_seg + ". Tail words here.")],
                              "task_id string, text string")
    rows = ch.semantic_chunks(t).collect()
    assert any(r["character_count"] >= 2500 and long_seg in r["content"] for r in rows)


def test_summary_entry_takes_a_window_slot(spark):
    mem = spark.createDataFrame(
        [("m", 0, "ingest_summary", "s", None)] + [("m", i, "query", f"q{i}", [1.0, 0.0]) for i in range(1, 30)],
        "memory_key string, seq long, type string, text string, vec array<double>")
    q = spark.createDataFrame([(1, "m", 19, [1.0, 0.0])], "query_id long, memory_key string, pos long, qvec array<double>")
    win = mm.memory_window(q.select("query_id", "memory_key", "pos"), mem, 20).collect()
    assert len(win) == 20 and min(r["seq"] for r in win) == 0
    picks = mm.memory_candidates(q, mem).collect()
    assert [r["seq"] for r in sorted(picks, key=lambda r: r["pick"])] == [1, 2]


def test_zero_vectors_score_zero(spark):
    rows = [("t", 0, "c0", "zero", [0.0, 0.0]), ("t", 1, "c1", "one", [1.0, 0.0])]
    v = spark.createDataFrame(rows, "task_id string, vec_id long, chunk_id string, content string, vec array<double>")
    q = spark.createDataFrame([(0, "t", [0.0, 0.0])], "query_id long, task_id string, qvec array<double>")
    hits = rt.search_similar(q, v, None, k=2, threshold=0.0).collect()
    assert len(hits) == 2 and all(h["similarity_score"] == 0.0 for h in hits)


def test_embed_distinct_shares_vectors_and_uses_the_cache(spark):
    from tessera.operators import embedding as em

    emb = em.PandasEmbedder(lambda: (lambda texts: np.array([[float(len(t)), 1.0] for t in texts])), 2, "len")
    df = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "bbb"), (4, "c")], "id long, text string")
    cache = spark.createDataFrame([("c",)], "t string").select(F.md5("t").alias("content_key"),
                                                                 F.array(F.lit(9.0), F.lit(9.0)).alias("vec"))
    out = {r["id"]: r["vec"] for r in em.embed_distinct(df, "text", emb, cache=cache).collect()}
    assert out[1] == out[2] == [2.0, 1.0] and out[3] == [3.0, 1.0] and out[4] == [9.0, 9.0]


def test_chat_turns_with_shared_task_memory(spark, sf):
    from tessera.plans import catalog
    from tessera.plans import pipelines as pl

    store = catalog.corpus_store(spark, sf)
    msgs = tb.routing_flags(spark, sf).unionByName(
        tb.messages(spark, sf).filter(F.col("role") != "user"), allowMissingColumns=True)
    answers = tb.user_turns(spark, sf).select("conv_id", "turn", "answer")
    out = pl.chat_turns(msgs, store, store.select("task_id", "chunk_id", "cluster_id"), use_memory=True,
                        answers=answers)
    plain = pl.chat_turns(msgs, store, store.select("task_id", "chunk_id", "cluster_id"))
    a = {(r["conv_id"], r["turn"]): r for r in out.collect()}
    b = {(r["conv_id"], r["turn"]): r for r in plain.collect()}
    assert set(a) == set(b)
    assert all(a[x]["mode_used"] == b[x]["mode_used"] for x in a)
    assert all(a[x]["prompt"] for x in a if a[x]["mode_used"] == "rag")


def test_answer_queries_uses_digest_when_over_budget_and_writes_memory(spark, sf):
    from tessera.config import Settings
    from tessera.plans import catalog
    from tessera.plans import pipelines as pl

    store = catalog.corpus_store(spark, sf)
    q = tb.user_turns(spark, sf)
    qids = [r["query_id"] for r in q.select("query_id").collect()]
    comp = spark.createDataFrame(
        [(i, "digest", f"digest of {i}", None) for i in qids] + [(i, "answer", f"answer {i}", None) for i in qids],
        "request_id long, stage string, text string, error string")
    out = pl.answer_queries(q, store, store.select("task_id", "chunk_id", "cluster_id"),
                            catalog.memory_table(spark, sf), Settings(max_evidence_chars=50), completions=comp)
    prompts = {r["query_id"]: r["prompt"] for r in out.prompts.collect()}
    assert all(f"digest of {i}" in prompts[i] for i in qids)
    rows = out.memory_rows.collect()
    assert len(rows) == 2 * len(qids) and any(r["text"].startswith("Q: ") and "\nA: answer " in r["text"] for r in rows)


def test_ingest_with_distinct_embedding_gives_the_same_vectors(spark, sf):
    from tessera.plans import pipelines as pl

    t = tb.transcripts(spark, sf)
    a = {r["chunk_id"]: r["vec"] for r in pl.ingest(t, cluster=False).vectors.collect()}
    b = {r["chunk_id"]: r["vec"] for r in pl.ingest(t, cluster=False, dedup=True).vectors.collect()}
    assert a == b and len(a) > 0
