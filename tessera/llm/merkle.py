"""Merkle manifest of a table: per source a 16-ary tree of row digests, one tree over the sources, a witness per row.

Rows are numbered per source and appended in order. Appending is aligned: 256 neighbours form a block,
whose open runs of 16 are closed as they fill; every closing extends the partial witnesses of all rows
below by their new siblings. The roots of the blocks, built all over the cluster, are then nothing but
further appends: the same step over them closes the next two levels, until one node per tree is left, and
the sources' roots are appended to a last tree in the same way. A block keeps the partial witnesses of its
rows in shared form (its nodes, level by level: a row's siblings are its run's other members), so the
closings above it extend one witness per block and not one per row, and rows get theirs when they are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import col, materialize
from tessera.operators.ordering import positions

FAN = 16
#: Levels that a block closes; a block has FAN ** LEVELS members.
LEVELS = 2
BLOCK = FAN ** LEVELS

_BLOCKS = "tree string, pos long, digest binary, alone binary, n int, ids array<long>, received array<binary>, nodes array<binary>"
_WITNESS = "array<struct<slot:int,siblings:binary>>"
_TOP = f"tree string, pos long, whole boolean, above {_WITNESS}"


def digest(text: bytes) -> bytes:
    """sha256 of the hexadecimal text of the digests in ``text``."""
    return hashlib.sha256(text.hex().encode()).digest()


def field(value: Column) -> Column:
    """``-`` for null, else byte count, ``:``, value."""
    s = value.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


class Appender:
    """Streaming aligned append of digests up to ``levels`` levels.

    ``nodes[l]`` holds the digests of level l in order. A full run is closed at once; ``finish`` closes
    the open ones from below, so every level has ceil(n / 16) nodes of the one under it.
    """

    def __init__(self, levels: int):
        self.levels = levels
        self.nodes = [bytearray() for _ in range(levels + 1)]
        self.open = [0] * levels  # members of the open run of a level

    def append(self, node: bytes, level: int = 0) -> None:
        self.nodes[level] += node
        if level < self.levels:
            self.open[level] += 1
            if self.open[level] == FAN:
                self.close(level)

    def close(self, level: int) -> None:
        run = self.nodes[level][-32 * self.open[level]:]
        self.open[level] = 0
        self.append(digest(run), level + 1)

    def finish(self) -> list[bytes]:
        for level in range(self.levels):
            if self.open[level]:
                self.close(level)
        return [bytes(n) for n in self.nodes]


def height(nodes: list[bytes]) -> int:
    """The first level with a single node."""
    return next(level for level, n in enumerate(nodes) if len(n) == 32)


def partial_witness(nodes: list[bytes], i: int, levels: int) -> list[tuple[int, bytes]]:
    """(slot, siblings) of member ``i`` at each of the first ``levels`` levels of its block."""
    out = []
    for level in range(levels):
        row, at = nodes[level], i // FAN ** level
        a = at // FAN * FAN
        out.append((at - a, row[32 * a:32 * at] + row[32 * (at + 1):32 * (a + FAN)]))
    return out


def fold(leaf: bytes, witness: list[tuple[int, bytes]]) -> bytes:
    """The root that ``leaf`` leads to with the siblings of its witness."""
    for slot, siblings in witness:
        leaf = digest(siblings[:32 * slot] + leaf + siblings[32 * slot:])
    return leaf


def _append_block(key, table):
    """One block: its members in order, closed level by level."""
    table = table.sort_by("pos")
    tree, no = key[0].as_py(), key[1].as_py()
    members = table.column("digest").to_pylist()
    app = Appender(LEVELS)
    for m in members:
        app.append(m)
    nodes = app.finish()
    # A lone member of the first block is its whole tree so far: nothing is closed above it.
    alone = table.column("alone")[0].as_py() if len(members) == 1 and no == 0 else nodes[height(nodes)]
    leaves = table.column("id").to_pylist(), table.column("received").to_pylist()
    kept = leaves if table.column("is_leaf")[0].as_py() else (None, None)
    return pa.table({"tree": pa.array([tree]), "pos": pa.array([no], pa.int64()), "digest": pa.array([nodes[-1]], pa.binary()),
                     "alone": pa.array([alone], pa.binary()), "n": pa.array([len(members)], pa.int32()),
                     "ids": pa.array([kept[0]], pa.list_(pa.int64())), "received": pa.array([kept[1]], pa.list_(pa.binary())),
                     "nodes": pa.array([nodes], pa.list_(pa.binary()))})


def _rounds(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Blocks over blocks, each round written, until every tree has a single one.

    ``nodes``: (tree, pos, digest, alone, id, received, is_leaf), ``pos`` dense from 0 per tree. A round has at
    most a 256th of the rows of the one before plus one per tree.
    """
    rounds = []
    while True:
        blocks = (nodes.withColumn("no", F.floor(F.col("pos") / BLOCK)).groupBy("tree", "no")
                  .applyInArrow(_append_block, _BLOCKS))
        rounds.append(materialize(blocks, f"{name}-{len(rounds)}"))
        if not (rounds[-1].agg(F.max("pos")).first()[0] or 0):
            return rounds
        nodes = rounds[-1].select("tree", "pos", "digest", "alone", F.lit(None).cast("long").alias("id"),
                                  F.lit(None).cast("binary").alias("received"), F.lit(False).alias("is_leaf"))


@dataclass
class Manifest:
    """``sources``/``top``: rounds of blocks of the sources' trees and of the tree over them; ``subroots``: (tree, pos,
    subroot); ``root``: None for an empty table. The name of a tree is ``=`` and its source; null has the empty name."""

    sources: list[DataFrame]
    top: list[DataFrame]
    subroots: DataFrame
    root: bytes | None


def build(docs: DataFrame, received: Column | None = None, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
          id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> Manifest:
    """Trees over all rows of ``docs``; every table of the manifest is written.

    A leaf is the digest of the row's ``columns``, nulls and empty texts apart, of whole texts of any
    length, hashed where they are read; other columns don't count. Rows ascend by id per
    source (null ids first, equal ids by leaf); repeated rows are leaves each. A null source is a tree of its
    own, before all others. ``received`` is the text as it came back later, if it may differ from the
    text: the leaf that it gives is kept beside the true one and enters no tree.
    """
    leaf = lambda text: F.unhex(F.sha2(F.concat(*[field(text if c == text_col else col(c)) for c in columns]), 256))
    d = docs.select(F.coalesce(F.concat(F.lit("="), col(source_col)), F.lit("")).alias("tree"),
                    col(id_col).cast("long").alias("id"), leaf(col(text_col)).alias("digest"),
                    (F.lit(None).cast("binary") if received is None else leaf(received)).alias("received"),
                    F.monotonically_increasing_id().alias("tie"))
    d = d.withColumn("received", F.nullif("received", "digest"))
    # Written before it is ranged: the texts are read once, not again for the sample of the ranges.
    d = positions(materialize(d, "merkle-leaves"), "tree", ["id", "digest", "tie"], "pos")
    sources = _rounds(d.select("tree", "pos", "digest", F.col("digest").alias("alone"), "id", "received", F.lit(True).alias("is_leaf")),
                      "merkle-source")
    roots = sources[-1].select("tree", F.col("alone").alias("subroot"))
    subroots = materialize(positions(roots.withColumn("all", F.lit(0)), "all", ["tree"], "pos").select("tree", "pos", "subroot"),
                           "merkle-subroots")
    top = _rounds(subroots.select(F.lit("").alias("tree"), "pos", F.col("subroot").alias("digest"), F.col("subroot").alias("alone"),
                                  F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("received"),
                                  F.lit(False).alias("is_leaf")), "merkle-top")
    root = top[-1].select("alone").first()  # one tree, one row
    return Manifest(sources, top, subroots, bytes(root[0]) if root else None)


def _extend(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Witnesses of a block's members: its partial witnesses extended by the block's own, (tree, pos, whole, above)."""

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                up = [(w["slot"], w["siblings"]) for w in r["above"]]
                levels = height(r["nodes"]) if r["whole"] else LEVELS
                for i in range(r["n"]):
                    w = partial_witness(r["nodes"], i, levels) + up
                    rows.append((r["tree"], r["pos"] * BLOCK + i, r["whole"] and r["n"] == 1, w))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.int64()),
                 pa.array([x[2] for x in rows], pa.bool_()), _witness_array([x[3] for x in rows])],
                names=["tree", "pos", "whole", "above"])

    j = blocks.join(above, ["tree", "pos"]).select("tree", "pos", "n", "nodes", "whole", "above")
    return j.mapInArrow(run, _TOP)


def _witness_array(witnesses: list[list[tuple[int, bytes]]]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(w) for w in witnesses])]).astype(np.int32)
    flat = [x for w in witnesses for x in w]
    return pa.ListArray.from_arrays(off, pa.StructArray.from_arrays(
        [pa.array([s for s, _ in flat], pa.int32()), pa.array([b for _, b in flat], pa.binary())], names=["slot", "siblings"]))


def _block_witnesses(m: Manifest) -> DataFrame:
    """(tree, pos, whole, above, subroot) per block of rows: everything that was closed above the block."""
    spark = m.subroots.sparkSession
    above = spark.createDataFrame([("", 0, True, [])], _TOP)
    for blocks in reversed(m.top):
        above = _extend(blocks, above)
    names = m.subroots.select("pos", F.col("tree").alias("name"), "subroot")
    above = materialize(above.join(names, "pos").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"),
                                                        F.lit(True).alias("whole"), "above", "subroot"), "merkle-above")
    subroots = above.select("tree", "subroot")
    for blocks in reversed(m.sources[1:]):
        above = _extend(blocks, above.drop("subroot"))
    return above if "subroot" in above.columns else above.join(subroots, "tree")


def _rows(m: Manifest, schema: str, make) -> DataFrame:
    """``make(id, leaf, received, witness, subroot)`` of every row, as rows of ``schema``."""
    above = _block_witnesses(m)
    j = m.sources[0].join(above, ["tree", "pos"]).select("n", "ids", "received", "nodes", "whole", "above", "subroot")
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):  # a block at a time
                r = b.slice(k, 1).to_pylist()[0]
                up = [(w["slot"], w["siblings"]) for w in r["above"]]
                levels = height(r["nodes"]) if r["whole"] else LEVELS
                out = []
                for i in range(r["n"]):
                    leaf = r["nodes"][0][32 * i:32 * i + 32]
                    out.append(make(r["ids"][i], leaf, r["received"][i] or leaf, partial_witness(r["nodes"], i, levels) + up,
                                    r["subroot"]))
                yield out

    def batched(batches):
        for out in run(batches):
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [_witness_array(list(c)) if n == "witness" else pa.array(c, _ARROW[n]) for n, c in zip(names, cols)], names=names)

    return j.mapInArrow(batched, schema)


_ARROW = {"doc_id": pa.int64(), "leaf": pa.string(), "subroot": pa.string(), "root": pa.string(), "proof_sha256": pa.string(),
          "folded_root": pa.string(), "verified": pa.bool_()}


def witnesses(m: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, witness): each row's siblings from its run up to the root."""
    spark = m.subroots.sparkSession
    schema = f"doc_id long, leaf string, subroot string, witness {_WITNESS}"
    if m.root is None:
        return spark.createDataFrame([], schema)
    return _rows(m, schema, lambda i, leaf, got, w, sub: (i, leaf.hex(), sub.hex(), w))


def audit(m: Manifest) -> DataFrame:
    """Every row's proof, and the root that its received leaf leads to with the original siblings.

    (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified). An empty table gives no rows.
    """
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if m.root is None:
        return m.subroots.sparkSession.createDataFrame([], schema)
    root = m.root

    def make(i, leaf, got, w, sub):
        folded = fold(got, w)
        return (i, leaf.hex(), sub.hex(), root.hex(), digest(b"".join(s for _, s in w)).hex(), folded.hex(), folded == root)

    return _rows(m, schema, make)


def tampered_text(text: str = "text", id_col: str = "doc_id") -> Column:
    """The text, its A-Z lower-cased in rows where 5 divides the crc32 of the id in decimal (a null id: unchanged)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(col(id_col).cast("string").cast("binary")) % 5 == 0
    return F.when(hit, F.translate(col(text), upper, upper.lower())).otherwise(col(text))


def manifest_audit(docs: DataFrame) -> DataFrame:
    """Manifest of ``docs`` audited against a copy with a fifth of the rows tampered with."""
    return audit(build(docs, tampered_text()))
