"""Substring search through an index of three-character strings (B5, F4, second plan).

The index holds, for every task and every three characters (a gram) of a lower-cased text, which documents have
it. Documents are numbered; a task of the writing job takes up to ``SEGMENT_DOCS`` consecutive documents or
``SEGMENT_GRAMS`` entries into a segment and emits one list per gram of it, so no row of the index grows with the
data and no pair of gram and document is ever exchanged, only the finished lists. The lists are
written in order of their grams with Parquet's delta encoding.

A search takes the ``RARE`` rarest grams of each query, intersects their lists segment by segment, and looks for
the whole query in the texts that are left, so the result is exact. Queries of fewer than three characters have
no gram and go through the pass over all texts (:func:`tessera.operators.retrieval.contains_search`).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.operators.retrieval import contains_search
from tessera.session import checkpoint, scratch_dir

SEGMENT_DOCS, SEGMENT_GRAMS = 1 << 16, 2_000_000
#: Grams of a query whose lists are intersected; the whole query is verified afterwards.
RARE = 4
_BITS = np.uint64(21)  # a code point has at most 21 bits, so a gram is one exact number
_POSTING = "task_id string, gram long, segment long, docs array<int>"


@dataclass(frozen=True)
class GramIndex:
    """``docs``: (doc_no, task_id, text, doc) with the lower-cased text and the row itself; ``postings``: (task_id,
    gram, segment, docs), where segment + entry is the number of a document; ``counts``: documents per gram."""

    docs: DataFrame
    postings: DataFrame
    counts: DataFrame


def text_grams(text: str) -> np.ndarray:
    """Distinct grams of a text, ascending; none below three characters."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    return np.unique((c[:-2] << (_BITS + _BITS)) | (c[1:-1] << _BITS) | c[2:]).view(np.int64)


def _lists(batches):
    """Lists per (task, gram, segment) from (doc_no, task_id, text) in order of doc_no."""
    held, total, segment = [], 0, None

    def emit():
        names = sorted({t for t, _, _ in held})
        for name in names:
            own = [(no, g) for t, no, g in held if t == name]
            grams = np.concatenate([g for _, g in own])
            numbers = np.repeat(np.array([no - segment for no, _ in own], np.int32), [len(g) for _, g in own])
            order = np.argsort(grams, kind="stable")  # documents stay ascending inside a gram
            grams, numbers = grams[order], numbers[order]
            first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
            off = np.append(first, len(grams)).astype(np.int32)
            for s in range(0, len(first), 65_536):
                e = min(s + 65_536, len(first))
                lists = pa.ListArray.from_arrays(pa.array(off[s:e + 1] - off[s]), pa.array(numbers[off[s]:off[e]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * (e - s), pa.string()), pa.array(grams[first[s:e]]),
                     pa.array(np.full(e - s, segment, np.int64)), lists], names=["task_id", "gram", "segment", "docs"])

    for batch in batches:
        for no, task, text in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (no - segment >= SEGMENT_DOCS or total >= SEGMENT_GRAMS):
                yield from emit()
                held, total = [], 0
            if not held:
                segment = no
            held.append((task, no, text_grams(text)))
            total += len(held[-1][2])
    if held:
        yield from emit()


def build_grams(docs: DataFrame, path: str | None = None, text_col: str = "content") -> GramIndex:
    """Index of the texts of ``docs`` (with ``task_id``), written to ``path`` (default: the shared scratch folder).

    Rows without a text or a task are found by nothing and left out; repeated rows are documents each.
    """
    spark = docs.sparkSession
    path = path or scratch_dir(spark, "grams")
    d = docs.filter(F.col(f"`{text_col}`").isNotNull() & F.col("task_id").isNotNull())
    d = d.select(F.monotonically_increasing_id().alias("doc_no"), "task_id", F.lower(F.col(f"`{text_col}`")).alias("text"),
                 F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    d.write.parquet(f"{path}/docs")
    stored = spark.read.schema(d.schema).parquet(f"{path}/docs")
    # The reader may pack files in any order; numbers must ascend inside a task.
    ordered = stored.select("doc_no", "task_id", "text").sortWithinPartitions("doc_no")
    lists = ordered.mapInArrow(_lists, _POSTING)
    # A gram that most segments have spans several ranges.
    (lists.repartitionByRange("task_id", "gram", "segment").sortWithinPartitions("task_id", "gram", "segment")
     .write.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false")
     .parquet(f"{path}/postings"))
    postings = spark.read.schema(_POSTING).parquet(f"{path}/postings")
    (postings.groupBy("task_id", "gram").agg(F.sum(F.size("docs")).cast("long").alias("n"))
     .repartitionByRange("task_id", "gram").write.parquet(f"{path}/counts"))
    return read_grams(spark, path)


def read_grams(spark: SparkSession, path: str) -> GramIndex:
    """The index written to ``path``."""
    return GramIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("docs", "postings", "counts")))


def _query_grams(batches):
    for batch in batches:
        found = [text_grams(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column(0).to_numpy(), [len(g) for g in found])),
             batch.column(1).take(pa.array(np.repeat(np.arange(len(found)), [len(g) for g in found]))),
             pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], names=["query_id", "task_id", "gram"])


def candidates(queries: DataFrame, index: GramIndex, query_col: str = "query") -> DataFrame:
    """(query_id, doc_no): documents that have the rarest grams of a query; none for a query without a gram."""
    q = queries.select(F.col("query_id").cast("long"), "task_id", F.lower(F.col(query_col)).alias("text"))
    q = q.filter((F.length("text") >= 3) & F.col("task_id").isNotNull())
    grams = q.mapInArrow(_query_grams, "query_id long, task_id string, gram long")
    known = grams.join(index.counts, ["task_id", "gram"], "left")
    # A gram that no document has sorts first (null), has no list, and its query is complete in no segment.
    rare = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("n").asc_nulls_first(), "gram"))
    chosen = known.withColumn("at", rare).filter(F.col("at") <= RARE)
    chosen = checkpoint(chosen.withColumn("need", F.count(F.lit(1)).over(Window.partitionBy("query_id"))))
    lists = index.postings.join(chosen.select("task_id", "gram", "query_id", "need"), ["task_id", "gram"])
    per = (lists.groupBy("query_id", "segment").agg(F.first("need").alias("need"), F.collect_list("docs").alias("lists"))
           .filter(F.size("lists") == F.col("need")))
    both = F.aggregate(F.slice("lists", 2, RARE), F.element_at("lists", 1), F.array_intersect)
    return (per.select("query_id", "segment", F.explode(both).alias("entry"))
            .select("query_id", (F.col("segment") + F.col("entry")).alias("doc_no")))


def contains_search_indexed(queries: DataFrame, index: GramIndex, cfg: Settings = Settings(), query_col: str = "query") -> DataFrame:
    """Case-insensitive substring search: the rows of :func:`tessera.operators.retrieval.contains_search` over the indexed documents.

    ``queries``: (query_id, task_id, query), one row per id. An empty query matches every document of its
    task, a null one none.
    """
    q = checkpoint(queries.select(F.col("query_id").cast("long"), "task_id", F.lower(F.col(query_col)).alias("query"))
                   .filter(F.col("query").isNotNull() & F.col("task_id").isNotNull()))
    columns = index.docs.schema["doc"].dataType.names
    found = checkpoint(candidates(q, index)).join(q.select("query_id", "query"), "query_id")
    hits = (index.docs.select("doc_no", "text", "doc").join(found, "doc_no")
            .filter(F.contains("text", "query")).select(*[F.col("doc").getField(c).alias(c) for c in columns], "query_id"))
    short = q.filter(F.length("query") < 3)
    if short.isEmpty():
        return hits
    rest = contains_search(short, index.docs.select("task_id", "text", "doc"), cfg, text_col="text")
    return hits.unionByName(rest.select(*[F.col("doc").getField(c).alias(c) for c in columns], "query_id"))


def search_report(queries: DataFrame, index: GramIndex, query_col: str = "query") -> DataFrame:
    """(query_id, texts_read, bytes_read, texts, bytes): texts that the search verifies, against all of the query's task.

    For queries of at least three characters; shorter ones read every text.
    """
    size = index.docs.select("doc_no", "task_id", F.octet_length("text").cast("long").alias("size"))
    whole = size.groupBy("task_id").agg(F.count(F.lit(1)).alias("texts"), F.sum("size").alias("bytes"))
    read = (candidates(queries, index, query_col).join(size.drop("task_id"), "doc_no").groupBy("query_id")
            .agg(F.count(F.lit(1)).alias("texts_read"), F.sum("size").alias("bytes_read")))
    q = queries.filter(F.length(query_col) >= 3).select(F.col("query_id").cast("long"), "task_id")
    return (q.join(whole, "task_id").join(read, "query_id", "left")
            .select("query_id", F.coalesce("texts_read", F.lit(0)).cast("long").alias("texts_read"),
                    F.coalesce("bytes_read", F.lit(0)).cast("long").alias("bytes_read"), "texts", "bytes"))
