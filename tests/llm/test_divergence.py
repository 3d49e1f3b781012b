"""Source divergence against its SQL twin over whole tables and awkward ones, and its block steps by hand."""

import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from scripts.oracle_check import digest
from tessera.llm import divergence as dv
from tessera.llm.queries import OP11_SQL


def twin(docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toArrow())
    return con.execute(OP11_SQL).df()


def check(docs):
    got, want = dv.source_divergence(docs).toPandas(), twin(docs)
    assert len(got) == len(want)
    assert not len(want) or digest(got) == digest(want)
    return got


@pytest.fixture(scope="module")
def small(make_docs):
    rnd = random.Random(5)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] + ["Ärger", "日本", "É"]
    rows = [(i, " ".join(rnd.choice(words[rnd.randint(0, 30):]) for _ in range(rnd.randint(0, 40))), "en", f"s{rnd.randint(0, 8)}")
            for i in range(200)]
    rows += [(300 + i, "the same text 12 AND-the same_again", "de", None if i % 2 else "only") for i in range(6)]
    rows += [(400, "too rare to be kept", "fr", "a"), (401, None, "fr", "b"), (402, "", None, "a"), (403, "12 34", None, None)]
    return make_docs(rows)


def test_awkward_rows(odd_docs, no_docs):
    check(odd_docs)
    assert len(check(no_docs)) == 0


def test_groups_without_terms_and_languages_without_kept_ones(small):
    got = check(small.repartition(4))
    fr = got[got.lang == "fr"]
    assert sorted(zip(fr.source, fr.item, fr.value)) == [("a", "b", 0), ("b", "a", 0)]
    assert set(got[(got.lang == "") & (got.part == "pair")].source) == {"a", ""}


def test_many_blocks_parts_and_tiles(small, monkeypatch):
    monkeypatch.setattr(dv, "BLOCK_POSTINGS", 40)
    monkeypatch.setattr(dv, "BLOCK_ROWS", 3)
    monkeypatch.setattr(dv, "TILE", 2)
    check(small)


def test_sample_table(spark, sf):
    got = check(spark.read.parquet(f"{sf}/documents.parquet"))
    assert got[got.part == "term"].groupby(["lang", "source"])["rank"].max().max() <= 200


def test_rows_gathered_in_pieces(monkeypatch):
    rnd = np.random.default_rng(1)
    rows = pd.DataFrame([(f"t{t}", g) for t in range(40) for g in range(9) if rnd.random() < 0.6], columns=["term", "gid"])
    rows["p"], rows["p0"], rows["parts"] = rnd.integers(5, 90, len(rows)), 3 + rows.gid, 2
    key = (pa.scalar("en"), pa.scalar(0), pa.scalar(1))
    whole = dv._scatter_rows(key, pa.Table.from_pandas(rows)).to_pandas()
    monkeypatch.setattr(dv, "GATHER", 7)
    pieces = dv._scatter_rows(key, pa.Table.from_pandas(rows)).to_pandas()
    assert digest(whole) == digest(pieces) and set(whole.g) == {1, 3, 5, 7}
    f = lambda p, q: (p - q) ** 2 // q
    at = {(r.term, r.gid): int(r.p) for r in rows.itertuples()}
    want = {}
    for (t, g), p in at.items():
        for h in range(9):
            if g % 2 and h != g and (t, h) in at:
                q, p0, q0 = at[t, h], 3 + g, 3 + h
                want[g, h] = want.get((g, h), 0) + f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
    assert {(r.g, r.h): r.value for r in whole.itertuples()} == want


def test_long_texts_are_split_and_counted_whole(monkeypatch):
    monkeypatch.setattr(dv, "SLICE", 10)
    text = "One two, three-four 5 fünf " * 9 + "x" * 50
    parts = list(dv._slices(text.encode()))
    assert len(parts) > 5
    assert b"".join(parts).split() == text.encode().translate(dv._FOLD).split()


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(10 ** 13, 3 * 10 ** 13), (0, 0), (6, 7), (9_000_000_000_000_000, 9_000_000_000_000_001)], "c long, n long")
    got = [r[0] for r in df.select(dv.share(F.col("c"), F.col("n"))).collect()]
    assert got == [1 + 10 ** 9 * (10 ** 13 + 1) // (3 * 10 ** 13), 1, 10 ** 9 + 1, 10 ** 9 + 1]
