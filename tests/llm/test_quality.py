import re
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from tessera.llm import queries
from tessera.llm.quality import (GRID, LEVEL, RISK, RULES, STEPS, base_failed, binomial_cdf, certified, features, judge,
                                 sequence, thresholds)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    wins = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    n = Counter(wins)
    hit = {j for i, w in enumerate(wins) if n[w] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(hit))


def check(rows, docs):
    text = {d.doc_id: d.text for d in docs}
    assert Counter(r.doc_id for r in rows) == Counter(d.doc_id for d in docs)
    for r in rows:
        b = base(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b, r.doc_id
        assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0])
        assert r.kept == (not r.base_failed and r.rule is None)


def test_query(spark, sf):
    check(queries.QUERIES["op2_quality_rules"](spark, sf).collect(), spark.read.parquet(f"{sf}/documents.parquet").collect())


def test_binomial_bound_is_exact():
    for n, p in ((20, 0.1), (200, 0.02)):
        for x in range(0, n + 1, 3):
            want = sum(comb(n, i) * p**i * (1 - p)**(n - i) for i in range(x + 1))
            assert binomial_cdf(x, n, p) == pytest.approx(want, rel=1e-9)


def test_fixed_sequence_stops_at_first_failure():
    assert certified(1000, [0, 0, 900], 0.02, 0.01) == 2
    assert certified(1000, [0, 900, 900], 0.02, 0.01) == 1
    assert certified(50, [0, 0, 0], 0.02, 0.01) == 0
    assert certified(217, [0], 0.02, 0.05 / 4) == 1 and certified(216, [0], 0.02, 0.05 / 4) == 0


def test_steps_are_learnt_from_other_strata():
    none = [0] * len(STEPS)
    assert sequence(5, 500, none, none) == sequence(500, 5, none, none) == list(range(len(STEPS)))
    bad, good = list(none), list(none)
    bad[20], bad[30], good[30], good[40] = 90, 90, 60, 50
    got = sequence(300, 100, good, bad)
    assert got[0] == 20 and 40 not in got and got.index(30) > got.index(20)


def direct(feats, quality):
    """Cutoffs of every stratum, computed text by text: (n_good, n_rejected, {rule: cutoff})."""
    rows = [(f, quality[f.doc_id]) for f in feats if quality.get(f.doc_id) is not None and not f.failed]
    strata = {f.stratum for f, _ in rows}
    tested = {f.stratum for f, q in rows if q}
    out = {}
    for s in strata:
        others = [(f, q) for f, q in rows if f.stratum != s]
        n = [sum(1 for _, q in others if q == side) for side in (True, False)]
        hit = [[sum(1 for f, q in others if q == side and f[r] > c) for r, c in STEPS] for side in (True, False)]
        good = [f for f, q in rows if q and f.stratum == s]
        cut, lost = {}, 0
        for k in sequence(*n, *hit):
            r, c = STEPS[k]
            sharper = {**cut, r: min(c, cut.get(r, c))}
            x = sum(any(f[q] > y for q, y in sharper.items()) for f in good)
            tail = sum(comb(len(good), i) * RISK**i * (1 - RISK) ** (len(good) - i) for i in range(x + 1))
            if x > RISK * len(good) or tail > LEVEL / max(1, len(tested)):
                break
            cut, lost = sharper, x
        out[s] = (len(good), lost, cut)
    return out


def cutoffs(spark, sf, copies=1):
    """The labelled documents ``copies`` times under ids of their own: (thresholds, direct ones, judged rows, labels)."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turn = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("turn")
    own = (F.col("doc_id") * copies + F.col("turn")).alias("doc_id")
    docs = docs.select("*", turn).select(own, "text", "lang")
    labels = labels.select("*", turn).select(own, "quality")
    feats = features(docs).withColumn("failed", base_failed()).cache()
    quality = {r.doc_id: r.quality == 1 for r in labels.collect() if r.quality is not None}
    got = {r.stratum: (r.n_good, r.n_rejected, {q: r[q] for q in RULES if r[q] is not None})
           for r in thresholds(feats, labels).collect()}
    return got, direct(feats.collect(), quality), judge(docs, labels).collect(), quality


def test_cutoffs_equal_direct_ones_and_reject_bad_texts(spark, sf):
    got, want, rows, quality = cutoffs(spark, sf, 60)
    assert got == want and all(cut for _, _, cut in got.values())
    bad = [r for r in rows if quality.get(r.doc_id) is False and not r.base_failed]
    assert bad and sum(not r.kept for r in bad) > 0.5 * len(bad)


def test_cutoffs_equal_direct_ones_with_few_labels(spark, sf):
    got, want, *_ = cutoffs(spark, sf)
    assert got == want


def test_certified_rules_catch_junk_and_keep_good_texts(spark, make_docs):
    good = [(i, " ".join(f"{'abcdefgh'[(i + j) % 8]}word{i}x{j}" for j in range(30)), "en", "s") for i in range(6000)]
    junk = [(10_000 + i, " ".join(f"SHOUT{i}X{j}!!" for j in range(30)), "en", "s") for i in range(50)]
    few = [(20_000 + i, " ".join(f"LOUD{i}X{j}!!" for j in range(30)), "fr", "s") for i in range(20)]
    docs = make_docs(good + junk + few)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6000)] + [(20_000 + i, 1, 0) for i in range(10)]
                                   + [(10_001, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    cut = {r.stratum: r for r in thresholds(features(docs).cache(), labels).collect()}
    assert cut["en"].upper_ratio is not None and cut["fr"].upper_ratio is None
    for r in RULES:
        assert cut["en"][r] is None or cut["en"][r] in GRID[r]
    kept = {r.doc_id: r.kept for r in judge(docs, labels).collect()}
    assert not any(kept[i] for i, *_ in junk) and all(kept[i] for i, *_ in few)
    assert sum(not kept[i] for i, *_ in good) <= 0.02 * len(good)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = judge(odd_docs, labels).collect()
    check(rows, odd_docs.collect())
    assert judge(no_docs, labels).collect() == []
