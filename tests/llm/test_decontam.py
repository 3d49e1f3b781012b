import random
import re
from collections import Counter

import duckdb

from scripts.oracle_check import digest
from tessera.llm import queries
from tessera.llm.decontam import contaminated_documents, decontaminated

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(UP))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(docs, items, t=0.8):
    sets = [(i, shingles(x)) for i, x in items if i is not None]
    out = []
    for d, text in docs:
        s = shingles(text)
        hits = sorted((-len(q & s) / len(q), i) for i, q in sets if q and len(q & s) / len(q) >= t)
        out.append((d, len(hits), hits[0][1] if hits else None, -hits[0][0] if hits else 0.0, bool(hits)))
    return out


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    name = "op8_containment_decontamination"
    a, b = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b) and digest(a) == digest(b)


def corpus():
    rnd = random.Random(5)
    words = lambda n: [f"v{rnd.randrange(5000)}" for _ in range(n)]
    items = [(i, " ".join(words(n))) for i, n in enumerate((5, 9, 15, 33, 60, 130, 400, 4, 0))]
    items += [(None, "an item without an id is not searched"), (50, items[3][1]), (51, None)]
    docs = []
    for i, (k, text) in enumerate(items[:7]):
        w = text.split()
        docs.append((10 * i, " ".join(words(900) + w + words(700))))
        docs.append((10 * i + 1, " ".join(words(30) + w[:len(w) // 2] + words(30) + w[len(w) // 2:]).upper()))
        docs.append((10 * i + 2, " ".join(words(80) + w[:len(w) // 3] + words(80))))
        docs.append((10 * i + 3, text))
    docs += [(900, None), (901, ""), (902, items[7][1]), (None, items[4][1]), (903, " ".join(words(9000)))]
    return docs, items


def test_items_of_all_sizes_in_long_documents_and_in_blocks(spark, make_docs):
    docs, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = make_docs([(i, t, "en", "s") for i, t in docs])
    key = lambda r: (r[0] is not None, r[0] or 0)
    want = sorted(brute(docs, items), key=key)
    for most in (20_000, 4):
        got = contaminated_documents(d, bench) if most > 4 else None
        if got is None:
            from tessera.llm.decontam import contamination
            c = contamination(d, bench, most=most)
            got = c.selectExpr("doc.doc_id", "n_items", "best_item", "containment", "n_items > 0 c")
        assert sorted(map(tuple, got.collect()), key=key) == want
    kept = decontaminated(d, bench)
    assert kept.columns == d.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in want if not r[4])


def test_empty_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminated(odd_docs, none).count() == odd_docs.count()
    some = spark.createDataFrame([(1, "word word word word word word")], "item_id long, text string")
    assert contaminated_documents(no_docs, some).collect() == []
    assert [r.doc_id for r in contaminated_documents(odd_docs, some).collect() if r.contaminated] == [7]
