"""Substring search by grams against a direct search, and what it reads."""

import random

import pytest

from tessera.operators import grams as gr
from tessera.sources import tables as tb

DOCS = "task_id string, content string, key long"
ASKED = "query_id long, task_id string, query string"


def direct(docs, asked):
    return sorted((q, key) for q, qt, query in asked for t, text, key in docs
                  if None not in (query, qt, text, t) and qt == t and query.lower() in text.lower())


def found(spark, docs, asked, parts=3):
    index = gr.build_grams(spark.createDataFrame(docs, DOCS).repartition(parts))
    hits = gr.contains_search_indexed(spark.createDataFrame(asked, ASKED), index)
    assert hits.columns == ["task_id", "content", "key", "query_id"]
    return sorted((r.query_id, r.key) for r in hits.collect())


@pytest.fixture(scope="module")
def made():
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcdE é😀") for _ in range(n))
    docs = [(rnd.choice("xy"), text(rnd.randrange(60)), i) for i in range(300)]
    docs += [("x", docs[0][1], 400), ("x", docs[0][1], 400), ("y", None, 500), (None, "abc", 501), ("x", "", 502),
             ("x", text(30_000), 503), ("y", "ab", 504), ("y", "ABC", 505)]
    asked = [(i, rnd.choice("xyz"), text(rnd.randrange(1, 6))) for i in range(60)]
    asked += [(100, "x", ""), (101, "y", None), (102, None, "abc"), (103, "x", docs[-3][1][100:20_000]), (104, "y", "abc"), (105, "y", "é😀"),
              (106, "y", "zzz"), (107, "x", "aaaa"), (108, "x", "ABC"), (109, "y", "é😀 ")]
    return docs, asked


def test_equals_direct_search(spark, made):
    docs, asked = made
    assert found(spark, docs, asked) == direct(docs, asked)


def test_small_segments_give_the_same(spark, made, monkeypatch):
    docs, asked = made
    monkeypatch.setattr(gr, "SEGMENT_DOCS", 7)
    monkeypatch.setattr(gr, "SEGMENT_GRAMS", 90)
    monkeypatch.setattr(gr, "RARE", 2)
    assert found(spark, docs, asked) == direct(docs, asked)


def test_empty_tables(spark, made):
    docs, asked = made
    assert found(spark, [], asked) == []
    assert found(spark, docs, []) == []


def test_text_read_falls_with_selectivity(spark, sf, tmp_path):
    docs = tb.transcripts(spark, sf).withColumn("task_id", gr.F.lit("all"))
    gr.build_grams(docs, str(tmp_path / "g"), text_col="text")
    index = gr.read_grams(spark, str(tmp_path / "g"))
    report = gr.search_report(tb.text_queries(spark, sf), index).collect()
    hits = gr.contains_search_indexed(tb.text_queries(spark, sf), index).groupBy("query_id").count().collect()
    assert len(report) == tb.text_queries(spark, sf).count() and all(r.texts_read >= 1 for r in report if r.query_id in {h.query_id for h in hits})
    assert sum(r.bytes_read for r in report) < 0.2 * sum(r.bytes for r in report)
