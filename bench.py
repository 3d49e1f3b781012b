"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], print one JSON line.

Each query is executed in full with the ``noop`` sink (every row computed, nothing collected
to the driver). The session is warmed once on the smallest table first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans import catalog  # noqa: E402
from tessera.session import build_session  # noqa: E402

HEADLINE = [
    "semantic_chunks",      # segment -> embed -> neighbour similarity -> fold (D2)
    "vector_topk",          # exact top-k per task (F1)
    "search_similar",       # F2 with re-score, threshold, clusters
    "retrieve",             # text queries over the chunk corpus (F3)
    "answer_queries",       # memory, centroid and sub-query retrieval, merge, evidence, prompt (J2)
    "corrective_rounds",    # grade, rewrite, retrieve again, merge, re-grade (G10)
    "kmeans_by_task",       # k-means per task, 10 starts (E3)
    "silhouette",           # all-pairs distances inside tasks (E6)
    "chat_turns",           # routing + retrieval or chat prompt (J3)
    "extractive_digest",    # TF-IDF sentence selection (H6)
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    names = sys.argv[1:] or HEADLINE
    spark = build_session()
    # Warm-up outside the timings: JVM code paths and the Python workers used by Arrow UDFs.
    from pyspark.sql import functions as F
    from tessera.operators.embedding import DEFAULT_EMBEDDER
    par = spark.sparkContext.defaultParallelism
    warm = spark.range(0, 100 * par, 1, par).select(F.col("id").cast("string").alias("t"))
    warm.select(DEFAULT_EMBEDDER.vector(F.col("t"))).write.format("noop").mode("overwrite").save()
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times = {}
    for name in names:
        t0 = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]} s", file=sys.stderr, flush=True)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
