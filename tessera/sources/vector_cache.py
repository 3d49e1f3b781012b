"""Vectors of texts embedded before, kept between runs.

One row per model and distinct text in a bucketed table (:mod:`generations`), keyed by the text's md5. A run
looks its distinct texts up with a join that does not exchange the table, embeds only those that are
missing, and appends them in one commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.embedding import DEFAULT_EMBEDDER, embed_texts
from tessera.session import checkpoint
from tessera.sources import generations as gn

TABLE = "text_vectors"


def _known(spark: SparkSession, path: str, manifest: gn.Manifest | None = None) -> DataFrame:
    found = gn.read_table(spark, path, TABLE, manifest=manifest)
    return found if found is not None else spark.createDataFrame([], "task_id string, model string, vec array<double>")


def embed_cached(df: DataFrame, text_col: str, path: str, embedder=None, out_col: str = "vec", buckets: int | None = None) -> DataFrame:
    """``df`` with ``content_key`` and the vector of its text; texts the table at ``path`` lacks are embedded and added.

    Each distinct text is embedded once, ever, per model name. Runs that overlap may both embed a text; the
    one that commits later leaves out what the other added. Null texts have neither key nor vector.
    """
    spark, emb = df.sparkSession, embedder or DEFAULT_EMBEDDER
    keyed = df.withColumn("content_key", tx.content_key(F.col(text_col)))
    name = F.concat(F.lit(emb.name + ":"), F.col("content_key"))
    asked = keyed.filter(F.col("content_key").isNotNull()).select(name.alias("task_id"), F.col(text_col).alias("_text"))
    missing = asked.dropDuplicates(["task_id"]).join(_known(spark, path).select("task_id"), "task_id", "left_anti")
    fresh = checkpoint(embed_texts(missing, "_text", ["task_id"], emb, "vec"))

    def make(m: gn.Manifest) -> dict[str, DataFrame]:
        new = fresh.join(_known(spark, path, m).select("task_id"), "task_id", "left_anti")
        return {TABLE: new.select("task_id", F.lit(emb.name).alias("model"), F.col("vec").cast("array<double>").alias("vec"))}

    if not fresh.isEmpty():
        gn.append_with(spark, path, make, buckets=buckets)
    vectors = _known(spark, path).select(F.col("task_id").alias("_name"), F.col("vec").alias(out_col))
    return keyed.withColumn("_name", name).join(vectors, "_name", "left").drop("_name")


def cache_report(spark: SparkSession, path: str) -> DataFrame:
    """(cache_size, embedding_dimension, model_name) of each model in the table."""
    return (_known(spark, path).groupBy(F.col("model").alias("model_name"))
            .agg(F.count(F.lit(1)).cast("long").alias("cache_size"), F.max(F.size("vec")).cast("long").alias("embedding_dimension"))
            .select("cache_size", "embedding_dimension", "model_name"))
