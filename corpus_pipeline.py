"""Corpus pipeline: documents to balanced shards of a cleaned, mixed corpus.

STAGES run in order, each on all rows its predecessor kept; every stage's result is written as Parquet
and read again, so a lost executor costs at most the running stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, language, mixing, near_dedup, sharding
from tessera.llm.common import materialize, packed, unpacked


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is one of the known ones; models are fitted on the rows of this stage."""
    return language.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every class of near copies."""
    return near_dedup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's share asks for: taken words / own words, rounded (0 to 2 rows).

    Ids are unique after the stages before; should one repeat, its rows are taken together.
    """
    counts = (mixing.mix(docs).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
              .withColumn("copies", F.floor(F.try_divide("taken", "size") + 0.5).cast("int"))
              .filter("copies > 0").select(F.col("doc_id").alias("id"), "copies"))
    d = packed(docs, F.col("doc_id").cast("long").alias("own"))
    d = d.join(materialize(counts, "mix-copies"), F.col("own").eqNullSafe(F.col("id")))
    return unpacked(d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot (8 shards of nearly equal bytes)."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: Sketches, trained models and hashed orders have no SQL form; tests compare with direct computations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split(" ")[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
