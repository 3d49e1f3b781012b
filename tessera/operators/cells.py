"""Exact top-k search that skips cells of vectors by angle bounds (F1, second plan).

The index deals the vectors of a task to the nearest of some centres; a cell knows the least and the
largest angle between its centre and its vectors. Angles obey the triangle inequality, so the angle
between a query and any vector of a cell is at least ``theta - largest`` and at least
``least - theta``, with ``theta`` the angle between query and centre. A search (1) scores, per query,
the cells of best bound until they hold k vectors, which gives a score that the k best must reach, and (2)
scores every further cell whose bound reaches it. What is left out cannot be among the k best, so the
result equals that of :func:`tessera.operators.retrieval.vector_topk`, ties included.

Vectors that are not of length one after normalisation (zero or nearly zero) have no angle; each task
keeps them in a cell of their own, bounded by their largest length. For scoring, consecutive cells
form bundles of bounded size (a larger cell, say of many equal vectors, is spread over several), and a query
goes once to each bundle that it has cells in, with their numbers: what is exchanged grows with queries
times bundles, not with queries times cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.operators.retrieval import _HIT_SCHEMA, _block_topk, _final_topk, _list_to_matrix, _merged, _normalize_rows
from tessera.session import checkpoint, scratch_dir

#: Most centres of one task; their number is the square root of the task's rows up to here.
MAX_CENTRES = 4096
#: Vectors assigned to centres in one group, and queries bounded in one group.
ASSIGN_ROWS, BOUND_ROWS = 50_000, 2_000
#: Queries of a bundle whose cells are gone through at a time, and hits held before they are cut to the k best.
PICK_ROWS, HELD_HITS = 4096, 1 << 18
#: Rounding allowance of an angle near zero.
SLACK = 1e-7
#: Normalised vectors shorter than this have no angle.
UNIT = 1 - 1e-9


@dataclass(frozen=True)
class CellIndex:
    """``members``: (task_id, cell, cell_id, vec_id, vec, angle); ``cells``: one row per cell with its centre and bounds."""

    members: DataFrame
    cells: DataFrame


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _copies(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` once for each of the ``_g`` groups of their task. Columns are aliased, as the other side
    of the cogroup may come from the same tables."""
    r = rows.join(groups, "task_id").withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_g") - 1).cast("array<int>")))
    return r.select(*[F.col(c).alias(c) for c in r.columns if c != "_g"])


def _assigned(v: DataFrame, centres: DataFrame, sizes: DataFrame) -> DataFrame:
    """(task_id, vec_id, vec, cell, angle): every vector with its nearest centre; cell -1 and the length for
    vectors without an angle. Tasks are salted, the centres of a task copied to each of its groups."""
    groups = sizes.select("task_id", F.ceil(F.col("n") / F.lit(ASSIGN_ROWS)).cast("int").alias("_g"))
    vs = v.join(groups, "task_id").withColumn("_s", F.pmod(F.xxhash64("vec_id"), F.col("_g")).cast("int")).drop("_g")
    cs = _copies(centres, groups)

    def run(vt: pa.Table, ct: pa.Table) -> pa.Table:
        m = _normalize_rows(_list_to_matrix(vt.column("vec"))) if vt.num_rows else np.zeros((0, 0))
        cell, angle = np.full(len(m), -1, np.int32), np.linalg.norm(m, axis=1) if len(m) else np.zeros(0)
        if ct.num_rows and len(m):
            c = _normalize_rows(_list_to_matrix(ct.column("centre")))
            number = ct.column("cell").to_numpy()
            unit = np.flatnonzero(angle >= UNIT)
            for s in range(0, len(unit), 1024):
                at = unit[s:s + 1024]
                score = m[at] @ c.T
                best = score.argmax(axis=1)
                cell[at], angle[at] = number[best], _angle(score[np.arange(len(at)), best])
        return pa.table([vt.column("task_id"), vt.column("vec_id"), vt.column("vec"), pa.array(cell), pa.array(angle)],
                        names=["task_id", "vec_id", "vec", "cell", "angle"])

    return (vs.groupBy("task_id", "_s").cogroup(cs.groupBy("task_id", "_s"))
            .applyInArrow(run, "task_id string, vec_id long, vec array<double>, cell int, angle double"))


def build_cells(vectors: DataFrame, path: str | None = None, vec: str = "vec") -> CellIndex:
    """Index of (task_id, vec_id, vec), written to ``path`` (default: the shared scratch folder) by cell.

    Centres are the distinct vectors of least hash, the square root of a task's rows of them (at most
    ``MAX_CENTRES``). Null vectors are found by nothing and left out, as in the plain search.
    """
    spark = vectors.sparkSession
    path = path or scratch_dir(spark, "cells")
    v = (vectors.select("task_id", F.col("vec_id").cast("long"), F.col(vec).cast("array<double>").alias("vec"))
         .filter(F.col("vec").isNotNull() & F.col("task_id").isNotNull()))
    sizes = checkpoint(v.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")))
    # Only ids and hashes are exchanged to choose the centres; equal vectors are one candidate.
    chance = (v.filter(F.exists("vec", lambda x: x != 0)).groupBy("task_id", F.xxhash64("vec").alias("h"))
              .agg(F.min("vec_id").alias("vec_id")))
    rank = F.row_number().over(Window.partitionBy("task_id").orderBy("h"))
    chosen = (chance.withColumn("cell", rank - 1).filter(F.col("cell") < MAX_CENTRES).join(sizes, "task_id")
              .filter(F.col("cell") < F.ceil(F.sqrt("n"))).select("task_id", "vec_id", "cell"))
    # A repeated id may name several vectors; any one of them serves as the centre.
    centres = checkpoint(v.join(chosen, ["task_id", "vec_id"]).groupBy("task_id", "cell")
                         .agg(F.first("vec").alias("centre")))
    found = _assigned(v, centres, sizes).withColumn("cell_id", F.xxhash64("task_id", "cell").cast("string"))
    (found.repartitionByRange("task_id", "cell", "vec_id").sortWithinPartitions("task_id", "cell")
     .write.parquet(f"{path}/members"))
    members = spark.read.schema(found.schema).parquet(f"{path}/members")
    per = members.groupBy("task_id", "cell", "cell_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("angle").alias("least"), F.max("angle").alias("largest"))
    per.join(centres, ["task_id", "cell"], "left").write.parquet(f"{path}/cells")
    return read_cells(spark, path)


def read_cells(spark: SparkSession, path: str) -> CellIndex:
    """The index written to ``path``. Fails if two cells of it share their 64-bit id."""
    cells = spark.read.parquet(f"{path}/cells")
    if not cells.groupBy("cell_id").count().filter("count > 1").isEmpty():
        raise ValueError("two cells share an id; build the index with other task names")
    return CellIndex(spark.read.parquet(f"{path}/members"), cells)


def _bounds(qmat: np.ndarray, ct: pa.Table) -> np.ndarray:
    """Largest score that any vector of each cell can have with each query (queries x cells)."""
    qn = _normalize_rows(qmat)
    size = np.linalg.norm(qn, axis=1)
    cell, largest = ct.column("cell").to_numpy(), ct.column("largest").to_numpy()
    least = ct.column("least").to_numpy()
    out = np.empty((len(qn), len(cell)))
    short = cell < 0
    out[:, short] = largest[short]
    if (~short).any():
        c = _normalize_rows(_list_to_matrix(ct.column("centre").filter(pa.array(~short))))
        theta = _angle(qn @ c.T)
        gap = np.maximum(theta - largest[~short], least[~short] - theta) - SLACK
        out[:, ~short] = np.cos(np.clip(gap, 0, np.pi))
    out[size < UNIT] = 1.0  # a query without an angle is bounded by no cell
    return out + SLACK


def _bundled(index: CellIndex, cfg: Settings) -> DataFrame:
    """The cells with their ``bundle`` and, beyond its width, the number of ``parts`` in this and the next ones."""
    width = F.lit(max(1, cfg.vectors_per_cell // 4))
    before = F.sum("n").over(Window.partitionBy("task_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    return (index.cells.withColumn("bundle", F.floor(F.coalesce(before, F.lit(0)) / width).cast("int"))
            .withColumn("parts", F.ceil(F.col("n") / width).cast("int")))


_PICKS = pa.schema([("query_id", pa.int64()), ("bundle", pa.int32()), ("picked", pa.list_(pa.int32())),
                    ("cells", pa.int64()), ("scored", pa.int64()), ("stored", pa.int64())])


def _choose(q: DataFrame, cells: DataFrame, first: bool) -> DataFrame:
    """(query_id, bundle, picked, cells, scored, stored): cells of each query by bundle; first round: best bounds until
    they hold k vectors; then: all others whose bound reaches ``floor``. Queries are dealt in groups, each with the
    cells of its task. ``cells`` and ``scored`` count a cell in its first bundle only."""
    sizes = (q.groupBy("task_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(BOUND_ROWS)).cast("int").alias("_g")))
    qs = q.join(sizes, "task_id").withColumn("_s", F.pmod(F.xxhash64("query_id"), F.col("_g")).cast("int")).drop("_g")
    cs = _copies(cells, sizes)

    def run(qt: pa.Table, ct: pa.Table) -> pa.Table:
        if not qt.num_rows or not ct.num_rows:
            return _PICKS.empty_table()
        ct = ct.sort_by("cell")
        n, number, parts = (ct.column(c).to_numpy() for c in ("n", "cell", "parts"))
        # One entry per cell and bundle, in order of bundles.
        own = np.repeat(np.arange(len(n)), parts)
        part = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = ct.column("bundle").to_numpy()[own] + part
        order = np.argsort(at, kind="stable")
        own, part, at = own[order], part[order], at[order]
        out = []
        for s in range(0, qt.num_rows, 256):
            group = qt.slice(s, 256)
            bound = _bounds(_list_to_matrix(group.column("qvec")), ct)
            if first:
                best = np.argsort(-bound, axis=1, kind="stable")
                last = (np.cumsum(n[best], axis=1) < group.column("k_row").to_numpy()[:, None]).sum(axis=1)
                take = np.zeros(bound.shape, dtype=bool)
                np.put_along_axis(take, best, np.arange(len(n))[None, :] <= last[:, None], axis=1)
            else:
                floor = group.column("floor").fill_null(-np.inf).to_numpy()
                take = bound >= floor[:, None]
                before = group.column("picked").combine_chunks()
                who = np.repeat(np.arange(len(before)), np.diff(before.offsets.to_numpy()))
                take[who, np.searchsorted(number, before.flatten().to_numpy())] = False
            who, entry = np.nonzero(take[:, own])
            if not len(who):
                continue
            start = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (at[entry[1:]] != at[entry[:-1]])))
            head = part[entry] == 0
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(who)), pa.int32()), pa.array(number[own[entry]], pa.int32()))
            out.append(pa.table([group.column("query_id").take(pa.array(who[start])), pa.array(at[entry[start]], pa.int32()), lists,
                                 pa.array(np.add.reduceat(head.astype(np.int64), start)),
                                 pa.array(np.add.reduceat(np.where(head, n[own[entry]], 0), start), pa.int64()),
                                 pa.array(np.full(len(start), n.sum()), pa.int64())], schema=_PICKS))
        return pa.concat_tables(out) if out else _PICKS.empty_table()

    return (qs.groupBy("task_id", "_s").cogroup(cs.groupBy("task_id", "_s"))
            .applyInArrow(run, "query_id long, bundle int, picked array<int>, cells long, scored long, stored long"))


def _bundle_topk(vt: pa.Table, qt: pa.Table) -> pa.Table:
    """The k best of each query among the vectors of its cells in one bundle."""
    schema = pa.schema([("query_id", pa.int64()), ("task_id", pa.string()), ("vec_id", pa.int64()),
                        ("raw_score", pa.float64()), ("rescore", pa.float64()), ("k_row", pa.int64())])
    if not vt.num_rows or not qt.num_rows:
        return schema.empty_table()
    order = np.argsort(vt.column("cell").to_numpy(), kind="stable")
    number, start = np.unique(vt.column("cell").to_numpy()[order], return_index=True)
    rows = dict(zip(number.tolist(), np.split(order, start[1:])))
    vids, vmat = vt.column("vec_id").to_numpy().astype(np.int64), _list_to_matrix(vt.column("vec"))
    found = []
    for s in range(0, qt.num_rows, PICK_ROWS):
        group = qt.slice(s, PICK_ROWS)
        qids, qk = (group.column(c).to_numpy().astype(np.int64) for c in ("query_id", "k_row"))
        qn = _normalize_rows(_list_to_matrix(group.column("qvec")))
        qnn = _normalize_rows(qn)
        picked = group.column("picked").combine_chunks()
        who, cell = np.repeat(np.arange(len(picked)), np.diff(picked.offsets.to_numpy())), picked.flatten().to_numpy()
        order = np.argsort(cell, kind="stable")
        asked, start = np.unique(cell[order], return_index=True)
        best, held, n_held = None, [], 0
        for c, at in zip(asked.tolist(), np.split(who[order], start[1:])):
            if c in rows:  # of a cell in parts, this bundle may have none
                held.append(_block_topk(vids[rows[c]], vmat[rows[c]], qids[at], qn[at], qnn[at], qk[at]))
                n_held += len(held[-1][0])
            if n_held > HELD_HITS:
                best, held, n_held = _merged(best, tuple(map(np.concatenate, zip(*held)))), [], 0
        if held:
            best = _merged(best, _merged(tuple(map(np.concatenate, zip(*held))), _NO_HITS))
        if best is not None:
            found.append(best)
    if not found:
        return schema.empty_table()
    oq, ov, oraw, ore, okr = map(np.concatenate, zip(*found))
    return pa.table([pa.array(oq), pa.array([vt.column("task_id")[0].as_py()] * len(oq), pa.string()), pa.array(ov),
                     pa.array(oraw), pa.array(ore), pa.array(okr, pa.int64())], schema=schema)


#: Merged with hits, it only cuts them to the k best of each query.
_NO_HITS = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64))


def _scored(q: DataFrame, picks: DataFrame, index: CellIndex, cells: DataFrame, cfg: Settings) -> DataFrame:
    asked = picks.select("query_id", F.col("bundle").alias("_b"), "picked").join(q, "query_id")
    sizes = asked.groupBy("task_id", "_b").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(cfg.broadcast_max_queries)).cast("int").alias("_r"))
    vs = (index.members.select("task_id", "cell", "vec_id", "vec")
          .join(cells.select("task_id", "cell", "bundle", "parts"), ["task_id", "cell"])
          .withColumn("_b", (F.col("bundle") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int"))
          .join(sizes, ["task_id", "_b"])
          .withColumn("_blk", F.explode(F.sequence(F.lit(0), F.col("_r") - 1).cast("array<int>")))
          .drop("bundle", "parts", "_r"))
    qs = asked.join(sizes, ["task_id", "_b"]).withColumn("_blk", F.pmod(F.xxhash64("query_id"), F.col("_r")).cast("int"))
    qs = qs.select(*[F.col(c).alias(c) for c in ("task_id", "_b", "_blk", "query_id", "qvec", "k_row", "picked")])
    keys = ["task_id", "_b", "_blk"]
    return vs.groupBy(*keys).cogroup(qs.groupBy(*keys)).applyInArrow(_bundle_topk, _HIT_SCHEMA)


def _search(queries: DataFrame, index: CellIndex, k: int, cfg: Settings, qvec: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    q = checkpoint(queries.select(F.col("query_id").cast("long"), "task_id", F.col(qvec).cast("array<double>").alias("qvec"),
                                  F.lit(k).alias("k_row")).filter(F.col("qvec").isNotNull() & F.col("task_id").isNotNull()))
    cells = _bundled(index, cfg)
    one = checkpoint(_choose(q, cells, True))
    near = checkpoint(_scored(q, one, index, cells, cfg))
    ranked = _final_topk(near, k).filter(F.col("rank") == k).select("query_id", F.col("raw_score").alias("floor"))
    before = one.groupBy("query_id").agg(F.flatten(F.collect_list("picked")).alias("picked"))
    more = q.join(before, "query_id").join(ranked, "query_id", "left")
    two = checkpoint(_choose(more, cells, False))
    rest = _scored(q, two, index, cells, cfg)
    report = (one.unionByName(two).groupBy("query_id")
              .agg(F.sum("cells").alias("cells_scored"), F.sum("scored").alias("rows_scored"), F.max("stored").alias("rows_stored")))
    return q, near.unionByName(rest), report


def vector_topk_cells(queries: DataFrame, index: CellIndex, k: int | None = None, cfg: Settings = Settings(),
                      qvec: str = "qvec") -> DataFrame:
    """F1 over an index of cells: the columns and rows of :func:`tessera.operators.retrieval.vector_topk`.

    ``queries``: (query_id, task_id, qvec), one row per id. A query of a task without vectors finds nothing.
    """
    k = cfg.k if k is None else k
    q, partial, _ = _search(queries, index, k, cfg, qvec)
    hits = _final_topk(partial, k).drop("task_id").join(q.select("query_id", "task_id"), "query_id")
    return hits.select("query_id", "task_id", "vec_id", "raw_score", "index_similarity", "similarity_score", "rank")


def cells_report(queries: DataFrame, index: CellIndex, k: int | None = None, cfg: Settings = Settings(),
                 qvec: str = "qvec") -> DataFrame:
    """(query_id, cells_scored, rows_scored, rows_stored): what an exact search of each query has to score."""
    return _search(queries, index, cfg.k if k is None else k, cfg, qvec)[2]
