"""Dense positions inside a key without sorting a whole key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checkpoint


def positions(df: DataFrame, key: str, order: Sequence[str], out: str = "pos",
              n_parts: int | None = None) -> DataFrame:
    """0-based position of each row within ``key`` in ``order`` (ties must be broken by ``order``).

    A plain ``row_number().over(partitionBy(key))`` sorts every row of a key in one task; a
    key holding a third of the data would then be one task. Here the rows are range-partitioned
    on (key, order) — range bounds come from a sample, so a hot key spans many partitions — and
    numbered inside each (key, partition) piece; the pieces' sizes give offsets through a
    per-key window over at most one row per partition.

    The partitioned rows are written once to the shared checkpoint folder, with their piece as a
    column: range bounds are sampled anew for every plan, so numbering and offsets must
    read the same pieces, not two samples of them.
    """
    order = list(order)
    # Without an explicit count AQE may merge adjacent ranges of a small input; merged pieces
    # stay contiguous and in order, which is all the offsets need.
    r = (df.repartitionByRange(n_parts, key, *order) if n_parts else df.repartitionByRange(key, *order))
    r = checkpoint(r.withColumn("_pid", F.spark_partition_id()))
    local = r.withColumn("_lp", F.row_number().over(Window.partitionBy(key, "_pid").orderBy(*order)) - 1)
    sizes = r.groupBy(key, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = sizes.withColumn(
        "_off", F.sum("_n").over(Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
    return (local.join(offs.select(key, "_pid", F.coalesce("_off", F.lit(0)).alias("_off")), [key, "_pid"])
            .withColumn(out, (F.col("_off") + F.col("_lp")).cast("long")).drop("_pid", "_lp", "_off"))


def with_row_ids(df: DataFrame, out: str) -> DataFrame:
    """``df`` with a unique LONG per row, written once so that every later use sees the same ids.

    For rows that are identified by several columns where an operator wants one id: nothing is
    packed into the id, so no column has a largest value.
    """
    return checkpoint(df.withColumn(out, F.monotonically_increasing_id()))
