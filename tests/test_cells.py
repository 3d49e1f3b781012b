"""Search by cells against the plain search (which other tests hold against brute force)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.operators import cells as ce
from tessera.operators import retrieval as rt
from tessera.sources import tables as tb


def rows_of(df):
    return sorted((r.query_id, r.task_id, r["rank"], r.vec_id, round(r.similarity_score, 9)) for r in df.collect())


def test_driver_vectors(spark, sf):
    q, v = tb.vector_queries(spark, sf), tb.vectors(spark, sf)
    assert rows_of(ce.vector_topk_cells(q, ce.build_cells(v), k=5)) == rows_of(rt.vector_topk(q, v, k=5))


@pytest.fixture(scope="module")
def clustered(spark):
    """Tight groups, a third of all rows one vector, zero, tiny and null vectors, a task of one row, a task only asked for."""
    rng = np.random.default_rng(5)
    heads = rng.normal(size=(20, 16))
    rows = [("a", i, (heads[i % 20] * 3 + 0.05 * rng.normal(size=16)).tolist()) for i in range(2000)]
    rows += [("a", 5000 + i, heads[0].tolist()) for i in range(1000)]
    rows += [("a", 7000 + i, [0.0] * 16) for i in range(8)] + [("a", 7100, [1e-13] * 16), ("a", 7200, None)]
    rows += [("one", 1, heads[1].tolist()), ("zero", 1, [0.0] * 16), (None, 3, heads[2].tolist())]
    asked = [(i, "a", (heads[i % 20] + 0.02 * rng.normal(size=16)).tolist()) for i in range(40)]
    asked += [(100, "a", [0.0] * 16), (101, "a", (-heads[3]).tolist()), (102, "one", heads[2].tolist()), (103, "none", heads[2].tolist()),
              (104, "a", None), (105, "zero", heads[2].tolist()), (106, "a", heads[0].tolist()), (107, "a", [1e-13] * 16)]
    v = spark.createDataFrame(rows, "task_id string, vec_id long, vec array<double>")
    return spark.createDataFrame(asked, "query_id long, task_id string, qvec array<double>"), v


@pytest.mark.parametrize("k", [1, 7])
def test_same_rows_as_the_plain_search(clustered, monkeypatch, k):
    q, v = clustered
    monkeypatch.setattr(ce, "ASSIGN_ROWS", 400)
    monkeypatch.setattr(ce, "BOUND_ROWS", 7)
    got = rows_of(ce.vector_topk_cells(q, ce.build_cells(v), k=k, cfg=Settings(vectors_per_cell=50, broadcast_max_queries=9)))
    assert got == rows_of(rt.vector_topk(q, v.filter("task_id is not null"), k=k))


def test_most_vectors_are_never_scored(clustered):
    q, v = clustered
    report = {r.query_id: r for r in ce.cells_report(q, ce.build_cells(v), k=5).collect()}
    plain = [r for i, r in report.items() if i < 40 and i % 20]  # group 0 holds the thousand equal vectors
    assert all(r.rows_stored == 3009 for r in plain)
    assert np.mean([r.rows_scored for r in plain]) < 0.2 * 3009
    assert 103 not in report and 104 not in report


def test_index_is_read_back_and_may_be_empty(spark, clustered, tmp_path):
    q, v = clustered
    ce.build_cells(v, str(tmp_path / "i"))
    again = ce.read_cells(spark, str(tmp_path / "i"))
    assert again.members.count() == 3011
    assert ce.vector_topk_cells(q, ce.build_cells(v.limit(0)), k=3).collect() == []


def test_a_query_is_exchanged_once_per_bundle(clustered):
    """All cells of a query travel in one row while they fit a bundle; cells beyond its width are spread over several."""
    q, v = clustered
    index, cfg = ce.build_cells(v), Settings(vectors_per_cell=400_000)
    asked = q.filter("qvec is not null and task_id is not null").withColumn("k_row", F.lit(5)).withColumn("floor", F.lit(-2.0))
    asked = asked.withColumn("picked", F.array().cast("array<int>"))
    rows = ce._choose(asked, ce._bundled(index, cfg), False).collect()
    n_cells = {r.task_id: r.n for r in index.cells.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    task = {r.query_id: r.task_id for r in asked.collect()}
    assert len(rows) == len({r.query_id for r in rows}) == 46
    assert all(len(r.picked) == r.cells == n_cells[task[r.query_id]] and r.scored == r.stored for r in rows)
    narrow = ce._choose(asked, ce._bundled(index, Settings(vectors_per_cell=400)), False)
    per = narrow.groupBy("query_id").agg(F.sum("cells").alias("cells"), F.sum("scored").alias("scored"), F.max("stored").alias("stored"),
                                         F.count(F.lit(1)).alias("bundles")).collect()
    assert all(r.cells == n_cells[task[r.query_id]] and r.scored == r.stored for r in per)
    assert all(15 < r.bundles <= 31 for r in per if task[r.query_id] == "a")  # 3,009 rows, a hundred each
