"""The vector cache: known texts are never embedded again, in later runs too."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import embedding as em
from tessera.sources import generations as gn
from tessera.sources import vector_cache as vc


def counting(spark, name="len"):
    seen = spark.sparkContext.accumulator(0)

    def make():
        def embed(texts):
            texts = list(texts)
            seen.add(len(texts))
            return np.array([[float(len(t)), 1.0] for t in texts]).reshape(-1, 2)
        return embed

    return em.PandasEmbedder(make, 2, name), seen


def test_known_texts_are_not_embedded_again(spark, tmp_path):
    path = str(tmp_path / "cache")
    emb, seen = counting(spark)
    rows = lambda texts: spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    first = {r.id: r.vec for r in vc.embed_cached(rows(["aa", "aa", "bbb", None, ""]), "text", path, emb).collect()}
    assert first == {0: [2.0, 1.0], 1: [2.0, 1.0], 2: [3.0, 1.0], 3: None, 4: [0.0, 1.0]} and seen.value == 3
    second = {r.id: r.vec for r in vc.embed_cached(rows(["bbb", "cccc", "aa"]), "text", path, emb).collect()}
    assert second == {0: [3.0, 1.0], 1: [4.0, 1.0], 2: [2.0, 1.0]} and seen.value == 4
    before = gn.current(spark, path).number
    assert vc.embed_cached(rows(["aa", "cccc"]), "text", path, emb).filter(F.col("vec").isNull()).count() == 0
    assert seen.value == 4 and gn.current(spark, path).number == before  # nothing new, no commit
    other, calls = counting(spark, "other")
    vc.embed_cached(rows(["aa"]), "text", path, other)
    assert calls.value == 1  # a model has its own vectors
    report = {r.model_name: (r.cache_size, r.embedding_dimension) for r in vc.cache_report(spark, path).collect()}
    assert report == {"len": (4, 2), "other": (1, 2)}


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    import pytest

    from tessera.session import ensure_checkpoint_dir

    unset = SimpleNamespace(get=lambda key, default: default)
    cluster = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: unset))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(cluster)
