"""Merkle manifest against a direct construction over all rows in one process, and its SQL twin."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from scripts.oracle_check import digest
from tessera.llm import merkle
from tessera.llm.queries import OP12_SQL


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(levels, i):
    out = []
    for row in levels[:-1]:
        a = i // 16 * 16
        out.append((i - a, [x for j, x in enumerate(row[a:a + 16]) if j != i - a]))
        i //= 16
    return out


def direct(rows):
    def leaf(r, text):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))

    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        rs = sorted(by_source[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees.append((rs, levels_of([leaf(r, r.text) for r in rs])))
    top = levels_of([t[-1][0] for _, t in trees]) if trees else [[None]]
    out = []
    for k, (rs, t) in enumerate(trees):
        for i, r in enumerate(rs):
            text = r.text
            if text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            way = siblings(t, i) + siblings(top, k)
            f = leaf(r, text)
            for slot, sib in way:
                f = h("".join(sib[:slot] + [f] + sib[slot:]))
            out.append((r.doc_id, t[0][i], t[-1][0], top[-1][0], h("".join("".join(s) for _, s in way)), f, f == top[-1][0]))
    return out


def check(docs):
    got = [tuple(r) for r in merkle.manifest_audit(docs).collect()]
    assert sorted(got, key=str) == sorted(direct(docs.collect()), key=str)
    return got


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert check(no_docs) == []
    assert merkle.witnesses(merkle.build(no_docs)).count() == 0


def test_sample_table_and_sql_twin(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = check(docs)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3  # some are tampered with, and only those fail
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert digest(merkle.manifest_audit(docs).toPandas()) == digest(con.execute(OP12_SQL).df())


@pytest.mark.parametrize("n", [1, 16, 17, 257])
def test_one_source(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), F.col("id")).alias("text"),
                                 F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(6).cast("long").alias("n_chars"))
    check(docs)


def test_several_rounds_and_many_sources(spark):
    base = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), F.col("id")).alias("text"),
                                    F.lit("en").alias("lang"), F.lit(6).cast("long").alias("n_chars"))
    hot = F.when(F.col("doc_id") < 4400, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id").cast("string")))
    check(base.withColumn("source", hot).repartition(5))  # 18 blocks of the hot tree; 601 sources: 3 blocks of the last tree


def test_witnesses_prove_rows(odd_docs):
    m = merkle.build(odd_docs)
    for r in merkle.witnesses(m).collect():
        assert merkle.fold(bytes.fromhex(r.leaf), [(w.slot, bytes(w.siblings)) for w in r.witness]) == m.root
        if r.witness:
            wrong = [(w.slot, bytes(w.siblings)) for w in r.witness]
            wrong[0] = (wrong[0][0], bytes(len(wrong[0][1])))
            assert merkle.fold(bytes.fromhex(r.leaf), wrong) != m.root


def test_appender_closes_runs_as_they_fill():
    app = merkle.Appender(2)
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(35)]
    for i, leaf in enumerate(leaves):
        app.append(leaf)
        assert len(app.nodes[1]) == 32 * ((i + 1) // 16)  # a partial witness grows when its run is complete
    nodes = app.finish()
    assert [len(n) // 32 for n in nodes] == [35, 3, 1]
    for i, leaf in enumerate(leaves):
        assert merkle.fold(leaf, merkle.partial_witness(nodes, i, 2)) == nodes[2]
