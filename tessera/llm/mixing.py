"""Low-discrepancy source schedule: which words of which source fill which slot of the mix.

The 2**p van der Corput points of a mix are mapped through the cumulative target shares of the
sources, so every stretch of slots holds every source in nearly its share. The slots of a source
are ranked in schedule order; its documents, in a fixed shuffled order, form a stream of words cut
into as many equal-token blocks as the source has slots, and block k is joined to the slot of
rank k. A source whose target exceeds its size goes through its stream a second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD_RE, col, materialize

WEIGHTS = (5.0, 2.0, 1.0)
#: 2**16 scheduled slots: a target share is met to 1.5e-5 before the block sizes make it exact.
SLOT_BITS = 16


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, sid, target, quota) from (source, source_size), one row per source.

    Sources in code-point order, null last, take the weights in turn. ``share`` times all sizes is
    dealt by weight; a target stops at ``cap`` times its source's size and the excess is dealt again
    by weight until none is above. The driver keeps two sums per round, never a list of sources.
    quota is the target rounded to words.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")  # one row per source, not per document
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("sid") % len(weights)) + 1).cast("int"))
    s = materialize(sizes.withColumn("sid", (F.row_number().over(by_name) - 1).cast("long")).withColumn("w", w),
                    "mix-sources")
    most = F.col("source_size") * F.lit(float(cap))
    pool, rate, capped = None, 0.0, -1
    while True:
        full = most <= F.lit(rate) * F.col("w") if pool is not None else F.lit(False)
        r = s.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, most)).alias("spent"),
                  F.sum(F.when(~full, F.col("w"))).alias("w"), F.count(F.when(full, 1)).alias("n")).first()
        pool = share * (r["all"] or 0)
        if r["n"] == capped or not r["w"]:
            break
        rate, capped = (pool - (r["spent"] or 0.0)) / r["w"], r["n"]
    target = F.least(most, F.lit(rate) * F.col("w"))
    return s.withColumn("target", target).withColumn(
        "quota", F.least(F.floor(F.col("target") + 0.5), F.floor(most)).cast("long"))


def slots_of(sources: DataFrame, bits: int = SLOT_BITS) -> DataFrame:
    """(sid, rank, slot, n_slots): the schedule. A source too small for a scheduled point gets one slot at the end.

    The points i / 2**p are van der Corput's in the order of their reversed bits, so a source's
    points are the whole numbers of its stretch of the cumulative shares, and its slots their reversals.
    """
    m = 1 << bits
    upto = Window.orderBy("sid")  # one row per source
    c = (sources.withColumn("_end", F.sum(F.col("quota").cast("decimal(38,0)")).over(upto))
         .withColumn("_all", F.sum(F.col("quota").cast("decimal(38,0)")).over(Window.partitionBy())))
    edge = lambda x: F.ceil(F.try_divide(x.cast("double"), F.col("_all").cast("double")) * m).cast("long")
    c = (c.filter("quota > 0")
         .withColumn("lo", edge(F.col("_end") - F.col("quota"))).withColumn("hi", edge(F.col("_end")))
         .withColumn("i", F.explode(F.when(F.col("hi") > F.col("lo"), F.sequence("lo", F.col("hi") - 1))
                                    .otherwise(F.array(F.lit(None).cast("long"))))))
    turned = F.conv(F.reverse(F.lpad(F.bin("i"), bits, "0")), 2, 10).cast("long")
    c = c.withColumn("slot", F.coalesce(turned, F.lit(m) + F.col("sid")))
    mine = Window.partitionBy("sid")
    return c.select("sid", (F.row_number().over(mine.orderBy("slot")) - 1).cast("long").alias("rank"), "slot",
                    F.greatest(F.col("hi") - F.col("lo"), F.lit(1)).alias("n_slots"))


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, bits: int = SLOT_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces): rows (row, doc_id, size, source_size, target), one per input row; pieces (slot, row,
    doc_id, from_word, to_word), the words of a row that fill a slot.

    Null or blank texts have size 0 and no pieces; a null source is the last source; repeated rows
    and ids are separate rows; an empty table gives two empty results. Extra columns are not read.

    Offsets in a source's shuffled stream are summed inside (source, piece of the hash), then shifted
    by the sizes of the pieces before, so a source with a third of all rows is spread over many tasks.
    """
    size = F.coalesce(F.regexp_count(col(text_col), F.lit(WORD_RE)), F.lit(0)).cast("long")
    d = docs.select(col(id_col).alias("doc_id"), col(source_col).cast("string").alias("source"), size.alias("size"))
    d = materialize(d.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    sources = materialize(source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")),
                                         weights, share, cap), "mix-targets")
    slots = slots_of(sources, bits)
    per_source = sources.join(slots.select("sid", "n_slots").distinct(), "sid", "left")
    d = (d.alias("d").join(per_source.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
         .select("d.row", "d.doc_id", "d.size", "s.sid", "s.source_size", "s.target", "s.quota", "s.n_slots"))
    n = d.count()
    parts = max(16, -(-n // 16384))
    key = F.xxhash64("doc_id", "size")
    some = d.filter("size > 0").withColumn("h", key).withColumn("part", F.pmod(F.xxhash64("h"), F.lit(parts)))
    totals = some.groupBy("sid", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("sid", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("shift"))
    inside = (Window.partitionBy("sid", "part").orderBy("h", "doc_id", "row")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (some.withColumn("upto", F.sum("size").over(inside)).join(totals, ["sid", "part"])
              .withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1))))
              .withColumn("a0", F.col("shift") + F.col("upto") - F.col("size") + F.col("turn") * F.col("source_size"))
              .withColumn("z0", F.least(F.col("a0") + F.col("size"), F.col("quota"))).filter("a0 < z0"))
    # Block k of a source holds the words from floor(k * quota / n_slots) on.
    block = lambda x: F.expr(f"(cast({x} + 1 as decimal(20,0)) * n_slots + quota - 1) div quota - 1")
    cut = placed.withColumn("rank", F.explode(F.sequence(block("a0"), block("(z0 - 1)"))))
    edge = lambda k: F.expr(f"(cast({k} as decimal(20,0)) * quota) div n_slots")
    cut = (cut.withColumn("a", F.greatest("a0", edge("rank"))).withColumn("z", F.least("z0", edge("(rank + 1)")))
           .filter("a < z"))
    pieces = (cut.join(slots.select("sid", "rank", "slot"), ["sid", "rank"])
              .select("slot", "row", "doc_id", (F.col("a") - F.col("a0")).alias("from_word"),
                      (F.col("z") - F.col("a0")).alias("to_word"), "turn"))
    return d.select("row", "doc_id", "size", "source_size", "target"), pieces


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot, n_pieces), one row per input row.

    taken counts the words of all its pieces; first_slot is the first slot of the schedule that one of its
    n_pieces fills (null: none), so rows in the order of first_slot are the mix in its low-discrepancy order.
    Very long texts fill many slots; rows of one slot are ties.
    """
    rows, pieces = schedule(docs, **options)
    per = pieces.groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"),
                                    F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n_pieces"))
    return rows.join(per, "row", "left").select("doc_id", "size", "source_size", "target",
                                                F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot",
                                                F.coalesce("n_pieces", F.lit(0)).alias("n_pieces"))
