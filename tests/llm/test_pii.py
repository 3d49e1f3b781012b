import hashlib
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import queries
from tessera.llm.pii import BASE_KINDS, find, find_pii, luhn

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, s):
    d = re.sub(r"[^0-9]", "", s)
    return {"email": True, "ip": all(int(p or 0) <= 255 for p in s.split(".")) if kind == "ip" else True,
            "card": 14 <= len(d) <= 19 and luhn(d) if kind == "card" else True,
            "phone": 10 <= len(d) <= 15}[kind]


def brute(text):
    out = [(m.start(), i, m.end(), k) for i, k in enumerate(BASE_KINDS) for m in re.finditer(PATTERNS[k], text or "")
           if valid(k, m.group())]
    return [(s, e, k) for s, _, e, k in sorted(out)]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a1203459.@+- ()é%\n_#", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert [x for x in find(text) if x[2] in BASE_KINDS] == brute(text)


def test_added_spans():
    spans = {k: [t[s:e] for s, e, kk in find(t) if kk == k] for t in [
        "see https://a.example.org/x?y=1, or http://nohost and password=f8cb0ab732d29a210e; token = \"f5d9a5f145ec\" key"]
        for k in ("url", "account")}
    assert spans == {"url": ["https://a.example.org/x?y=1"], "account": ["f8cb0ab732d29a210e", "f5d9a5f145ec"]}


def check(rows, docs):
    text = {d.doc_id: d.text for d in docs}
    assert Counter(r.doc_id for r in rows) == Counter(d.doc_id for d in docs)
    for r in rows:
        b = brute(text[r.doc_id])
        n = Counter(k for _, _, k in b)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in BASE_KINDS)
        want = ",".join(f"{k}:{s}:{e}" for s, e, k in b)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_query(spark, sf):
    check(queries.QUERIES["op4_pii_anchors"](spark, sf).collect(), spark.read.parquet(f"{sf}/documents.parquet").collect())


def test_odd_rows(odd_docs, no_docs, make_docs):
    check(find_pii(odd_docs).collect(), odd_docs.collect())
    assert find_pii(no_docs).collect() == []
    long = make_docs([(1, "9" * 5000 + ".1.2.3 😀 a@b.c " + "x" * 100_000 + " 4111 1111 1111 1111", "en", "s")])
    assert [(r.n_email, r.n_ip, r.n_card) for r in find_pii(long).collect()] == [(1, 0, 1)]
