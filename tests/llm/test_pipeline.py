from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm.common import materialize

from .test_decontam import brute as contained
from .test_mixing import laws as mixing_laws
from .test_mixing import mix
from .test_near_dedup import classes
from .test_sharding import laws as sharding_laws


@pytest.fixture(scope="module")
def results(spark, sf):
    """Every stage's input and output, written and read again."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        got = materialize(stage(spark, docs, sf), name.split(" ")[0])
        out.append((name, docs, got))
        docs = got
    return out


def test_stages_keep_the_columns(results):
    for _, before, after in results[:-1]:
        assert after.dtypes == before.dtypes


def test_language_keeps_clean_documents(results):
    _, before, after = results[0]
    assert after.count() >= 0.99 * before.count()


def test_one_document_of_each_class_stays(results):
    _, before, after = results[1]
    docs = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, c in classes(docs)})


def test_contaminated_documents_go(results, spark, sf):
    _, before, after = results[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = [d for d, _, _, _, bad in contained([(r.doc_id, r.text) for r in before.collect()], items) if not bad]
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)


def test_mix_takes_documents_in_their_share(results):
    _, before, after = results[3]
    rows = mix(before).collect()
    mixing_laws(rows, before.collect())
    want = Counter({r.doc_id: int(r.taken / r.size + 0.5) for r in rows if r.size})
    assert Counter(r.doc_id for r in after.collect()) == +want


def test_shards_of_the_result(results, spark, sf):
    _, before, after = results[4]
    sharding_laws(after.collect(), before.collect(), 8)
    key = lambda df: sorted((r.doc_id, r.shard, r.slot) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(after)


def test_odd_and_empty_inputs(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, sf), name.split(" ")[0])
        assert {"shard", "slot", "doc_id", "text"} <= set(docs.columns)
    assert docs.count() == 0
