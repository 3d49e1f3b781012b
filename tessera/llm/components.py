"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node of its component.

    Each round links the larger neighbours of a node to the smallest one, then the smaller ones;
    minima are pre-aggregated, and joins on a hub with many neighbours are split by AQE. Only two
    numbers per round reach the driver. The rounds end when the links stop changing.
    """
    e = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .filter("a < b").distinct(), "links")
    state = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (large.join(low, "b").select(F.col("m").alias("r"), F.explode(F.array("a", "b")).alias("x"))
                 .filter("x > r").select(F.col("r").alias("a"), F.col("x").alias("b")).distinct())
        e = materialize(small, "links")
        now = _state(e)
        if now == state:
            break
        state = now
    nodes = e.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return nodes.unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def joined_components(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after adding ``links`` (a, b) to components found before: only roots are linked anew."""
    if labels is None:
        return components(links)
    a, b = labels.toDF("a", "ra"), labels.toDF("b", "rb")
    tops = components(links.join(a, "a", "left").join(b, "b", "left")
                      .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    known = (labels.join(tops.toDF("root", "top"), "root", "left")
             .select("node", F.coalesce("top", "root").alias("root")))
    return materialize(known.unionByName(tops.join(labels.select("node"), "node", "left_anti")), "components")
