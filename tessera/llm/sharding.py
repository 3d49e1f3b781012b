"""Histogram sort: byte-balanced shards from exactly counted key boundaries, one exchange.

Rows are ordered by (hash of the text, hash of id and text). Candidate boundaries ("probes") are
cut into that key range; one grouped aggregation per round counts the exact bytes below every
probe over all partitions, and only the cells that hold a splitter are probed again, until each
splitter is near enough to its target. Rows then move once, straight to their place.

Equal texts are neighbours in the key order, so they share a shard; a splitter falls inside a
group of equal texts only where ending at the group's edge would miss the target by more than
``group_tolerance`` of a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import col, materialize, packed, unpacked

#: Bits of the key refined per round: 4,096 probes in each cell that holds a splitter.
PROBE_BITS = 12
_LOW = -(1 << 63)
_OUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _keys(docs: DataFrame, id_col: str, text_col: str) -> list:
    t, i = col(text_col), col(id_col)
    return [(F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(t).alias("k1"), F.xxhash64(i, t).alias("k2")]


def _count(keys: DataFrame, cells: list[tuple[int | None, int]], bits: int, step: int) -> dict:
    """Exact (bytes, rows) of the probes inside ``cells``; a cell is (fixed k1 or None, prefix of the key).

    At most ``len(cells) << step`` rows reach the driver, whatever the data's size.
    """
    key = "k1" if cells[0][0] is None else "k2"
    if bits == 0 and key == "k1":
        wanted = F.lit(True)
    else:
        wanted = F.lit(False)
        for fixed, prefix in cells:
            inside = F.lit(True) if bits == 0 else F.shiftright(F.col(key), 64 - bits) == F.lit(prefix)
            wanted = wanted | (inside if fixed is None else inside & (F.col("k1") == F.lit(fixed)))
    fixed = F.lit(None).cast("long") if key == "k1" else F.col("k1")
    rows = (keys.filter(wanted)
            .groupBy(fixed.alias("f"), F.shiftright(F.col(key), 64 - bits - step).alias("p"))
            .agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect())
    out: dict = {}
    for r in sorted(rows, key=lambda r: r["p"]):
        out.setdefault((r["f"], r["p"] >> step if bits else 0), []).append((r["p"], r["b"], r["n"]))
    return out


def splitters(keys: DataFrame, n_shards: int, tolerance: float = 0.001,
              group_tolerance: float = 0.05) -> list[tuple[int, int]]:
    """``n_shards - 1`` ascending boundaries (k1, k2): a shard holds the keys from its boundary on.

    ``keys`` has (k1, k2, size). Refinement of a splitter ends at a boundary within ``tolerance``
    of a shard, at a cell of one row, or at the edge of a group of equal texts within
    ``group_tolerance``.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    shard = total / n_shards
    found: dict[int, tuple[int, int]] = {}
    # splitter -> (fixed k1 or None, prefix, bits known, bytes below the cell)
    open_ = {i: (None, 0, 0, 0) for i in range(1, n_shards)} if total else {}
    while open_:
        state = {(c[0] is None, c[2]) for c in open_.values()}
        for primary, bits in state:
            here = {i: c for i, c in open_.items() if (c[0] is None, c[2]) == (primary, bits)}
            step = min(PROBE_BITS, 64 - bits)
            counted = _count(keys, sorted({(c[0], c[1]) for c in here.values()}, key=str), bits, step)
            for i, (fixed, prefix, _, below) in here.items():
                target = shard * i
                for p, size, n in counted[(fixed, prefix if bits else 0)]:
                    if below + size >= target:
                        break
                    below += size
                low, high = p << (64 - bits - step), (p + 1) << (64 - bits - step)
                miss = min(target - below, below + size - target)
                edge = low if target - below <= below + size - target else high
                last = bits + step == 64
                near = miss <= (group_tolerance if primary and last else tolerance) * shard
                if near or n == 1 or (last and not primary):
                    if primary:
                        found[i] = (edge, _LOW)
                    else:
                        found[i] = (fixed, edge) if edge < 1 << 63 else (fixed + 1, _LOW)
                    del open_[i]
                elif last:
                    open_[i] = (p, 0, 0, below)
                else:
                    open_[i] = (fixed, p, bits + step, below)
    return [found.get(i, (_LOW, _LOW)) for i in range(1, n_shards)] if total else []


def _at_or_after(s: tuple[int, int]):
    if s[0] >= 1 << 63:
        return F.lit(False)
    return (F.col("k1") > F.lit(s[0])) | ((F.col("k1") == F.lit(s[0])) & (F.col("k2") >= F.lit(s[1])))


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
                    tolerance: float = 0.001, group_tolerance: float = 0.05,
                    columns: list[str] | None = None) -> DataFrame:
    """``docs`` with size, text_crc32, law ("bytes"), shard, slot and grown_shard (null).

    size is the UTF-8 length plus 1 (null text: 1, checksum 0, a group of its own); slot runs from
    0 without gaps inside a shard. Null ids are ordinary keys; repeated rows each get a slot; an
    empty table gives no rows. Input columns named like an output column are replaced.
    ``columns``: the input columns to carry through the exchange (default: all).

    Slots are numbered inside (shard, piece), a piece being a hash of the key, and shifted by the
    counted sizes of the pieces before: no task sees a whole shard.
    """
    kept = docs.select(*[col(c) for c in dict.fromkeys([*(columns or docs.columns), id_col, text_col])])
    keys = materialize(docs.select(*_keys(docs, id_col, text_col)).drop("text_crc32"), "shard-keys")
    n = keys.count()
    cuts = splitters(keys, n_shards, tolerance, group_tolerance)
    shard = F.lit(0)
    for s in cuts:
        shard = shard + _at_or_after(s).cast("int")
    pieces = max(16, -(-n // (n_shards * 8192)))
    piece = F.pmod(F.xxhash64("k2"), F.lit(pieces)).cast("int")
    sizes = keys.groupBy(shard.alias("shard"), piece.alias("piece")).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "piece", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("shift"))
    wanted = columns or docs.columns
    rows = packed(kept, *_keys(kept, id_col, text_col))
    rows = rows.withColumn("doc", F.struct(*[F.col("doc").getField(c).alias(c) for c in wanted]))
    rows = rows.withColumns({"shard": shard, "piece": piece})
    inside = Window.partitionBy("shard", "piece").orderBy("k1", "k2")
    out = (rows.withColumn("at", F.row_number().over(inside) - 1).join(sizes, ["shard", "piece"])
           .withColumn("slot", (F.col("shift") + F.col("at")).cast("long"))
           .withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}))
    return unpacked(out, wanted, *_OUT)
