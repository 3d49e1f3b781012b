import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import queries
from tessera.llm.language import LANGUAGES, accepted, decide, identify, likelihoods, page_fields, train, trigrams


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = train(docs.filter(~held), sample_rows=60)
    rows = identify(docs.filter(held), declared_col=None, model=model).join(docs, "doc_id").collect()
    assert len(rows) > 30 and np.mean([r.language == r.lang for r in rows]) >= 0.97


def test_query_accepts_clean_documents(spark, sf):
    rows = queries.QUERIES["op7_language_fusion"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert np.mean([r.accepted for r in rows]) >= 0.99 and np.mean([r.language == r.declared for r in rows]) >= 0.97
    again = queries.QUERIES["op7_language_fusion"](spark, sf).collect()
    assert sorted(rows) == sorted(again)


def test_pages_use_markup_host_and_suffix(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    f = page_fields(pages).collect()
    assert all(r.suffix == r.host.rsplit(".", 1)[-1] and "<" not in r.text for r in f)
    rows = queries.QUERIES["page_languages"](spark, sf).collect()
    assert len(rows) == len(f) and np.mean([r.language == r.declared for r in rows]) >= 0.9


def fixed_model():
    model = np.full((1 << 15, 5), -10.0, np.float32)
    for k, text in enumerate(("the and of", "que les des", "und der die", "los las que el")):
        bucket, _ = trigrams(pa.array([text]))
        model[bucket, k] = -4.0
    model[:, 4] = -8.0
    return model


def fused(rows, model):
    """The posterior by direct loops over the rows."""
    k = len(LANGUAGES) + 1
    ll = likelihoods(model, pa.array([t or "" for _, t, _, _ in rows]))
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    mass = [np.rint(soft(x) * 1e6) / 1e6 for x in ll]
    total = sum(mass) + 1.0
    kinds = {d for _, _, d, _ in rows if d is not None}
    up = (sum(mass) + 20 * total / total.sum()) / (sum(m.sum() for m in mass) + 20)
    out = []
    for i, (_, _, d, h) in enumerate(rows):
        host = sum((m for m, r in zip(mass, rows) if r[3] == h), np.zeros(k)) - mass[i]
        prior = (host + 20 * up) / (host.sum() + 20)
        x = ll[i] + np.log(prior)
        if d is not None:
            told = sum((m for m, r in zip(mass, rows) if r[2] == d), np.zeros(k)) - mass[i]
            x = x + np.log((told + 1) / (total + max(len(kinds), 1)))
        out.append(soft(x))
    return out


def test_fusion_equals_direct_computation(make_docs):
    rows = [(i, ["the and of the and", "und der die und der", "que les des les", "los las que el"][i % 4],
             ["en", "de", "fr", None][i % 4], "h1" if i % 3 else None) for i in range(40)]
    rows += [(100, "the", None, "h2"), (101, "que", "fr", "h1"), (102, "", "en", "h1"), (103, None, None, None)]
    got = {r.id: r for r in decide(make_docs([(i, t, d, h) for i, t, d, h in rows]), fixed_model()).collect()}
    names = [*LANGUAGES, "und"]
    for (i, t, _, _), p in zip(rows, fused(rows, fixed_model())):
        assert got[i].language == names[int(p.argmax())] and abs(got[i].probability - p.max()) < 1e-6
        assert t or not got[i].accepted


def test_odd_rows(odd_docs, no_docs):
    rows = identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert not by[3].accepted and not by[4].accepted and not by[5].accepted and by[1].accepted
    kept = accepted(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.accepted)
    assert identify(no_docs).collect() == [] and accepted(no_docs).collect() == []


def test_two_thousand_declared_values_all_count(make_docs):
    rows = [(i, "the and of the and", f"x{i % 2000}", "h1") for i in range(2001)] + [(5000, "und der die", "x1", "h2")]
    got = {r.id: r.probability for r in decide(make_docs(rows), fixed_model()).collect()}
    for (i, _, _, _), p in zip(rows, fused(rows, fixed_model())):
        assert abs(got[i] - p.max()) < 1e-6


def test_a_text_that_is_a_third_of_all_rows_is_learnt_once(make_docs):
    rows = [(i, f"the and of number {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} in the house", "en", "s") for i in range(60)]
    rows += [(100 + i, f"und der die das haus {'abcdefghij'[i]}", "de", "s") for i in range(10)]
    copies = [(1000 + i, "zzz qqq xxx", "en", "s") for i in range(200)]
    once = train(make_docs([*rows, copies[0]]), sample_rows=1000)
    assert np.array_equal(once, train(make_docs([*rows, *copies]), sample_rows=1000))
    few = train(make_docs([*rows, *copies]), sample_rows=5)
    bucket, _ = trigrams(pa.array(["und der"]))
    assert (few[bucket, 2] > few[bucket, 0]).mean() > 0.5  # every language keeps its own sample


def test_null_texts_and_labels_do_not_train(make_docs):
    flat = train(make_docs([(1, None, "en", "s"), (2, "text without a label", None, "s"), (3, "text", "zz", "s")]))
    assert np.allclose(flat, flat[0, 0])
