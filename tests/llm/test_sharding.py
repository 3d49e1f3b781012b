import zlib
from collections import Counter, defaultdict

from tessera.llm import queries
from tessera.llm.sharding import shard_documents


def laws(rows, docs, n, loose=1.0):
    assert Counter(r.doc_id for r in rows) == Counter(d.doc_id for d in docs)
    size, slots, by_text = Counter(), defaultdict(list), defaultdict(set)
    text = {}
    for d in docs:
        text[d.doc_id] = d.text
    for r in rows:
        t = text[r.doc_id]
        assert r.size == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode())
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        by_text[t].add(r.shard)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    most = max([r.size for r in rows], default=0)
    total = sum(size.values())
    assert all(abs(size[s] - total / n) <= most + loose * 0.05 * total / n + 1 for s in range(n))
    return by_text


def test_query_is_balanced_and_gapless(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = queries.QUERIES["op6_histogram_shards"](spark, sf).collect()
    by_text = laws(rows, docs, 8)
    assert sum(len(s) > 1 for s in by_text.values()) == 0
    again = queries.QUERIES["op6_histogram_shards"](spark, sf).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_one_group_of_copies_larger_than_a_shard_is_split(make_docs):
    docs = make_docs([(i, "same text of a large group", "en", "s") for i in range(900)]
                     + [(1000 + i, f"text number {i} of the others", "en", "s") for i in range(600)])
    by_text = laws(shard_documents(docs).collect(), docs.collect(), 8)
    assert len(by_text["same text of a large group"]) > 2


def test_odd_rows(odd_docs, no_docs):
    laws(shard_documents(odd_docs, 3).collect(), odd_docs.collect(), 3)
    out = shard_documents(odd_docs, 3)
    assert [c for c in out.columns if c not in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")] == [
        c for c in odd_docs.columns if c not in ("size", "shard")]
    assert shard_documents(no_docs).collect() == []
