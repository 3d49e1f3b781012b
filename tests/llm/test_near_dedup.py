import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import queries
from tessera.llm.components import components
from tessera.llm.near_dedup import alignment, deduplicated, near_duplicates, order_sketch, parities

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sequence(text):
    """Occurrence-labelled five-word shingles."""
    w = WORD.findall(text or "")
    sh = [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] * bool(w)
    seen, out = Counter(), []
    for s in sh:
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def common_order(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def similar(a, b, t=0.8):
    if not a or not b or min(len(a), len(b)) < t * max(len(a), len(b)):
        return False
    m = len(set(a) & set(b))
    if m / (len(a) + len(b) - m) < t:
        return False
    m = common_order(a, b)
    return m / (len(a) + len(b) - m) >= t


def classes(docs):
    """Smallest id of each component of all pairs compared directly."""
    texts = sorted({d[1] or "" for d in docs})
    seqs = [sequence(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similar(seqs[i], seqs[j]):
                root[find(i)] = find(j)
    of = {t: find(i) for i, t in enumerate(texts)}
    least = {}
    for i, t in docs:
        if i is not None:
            least[of[t or ""]] = min(i, least.get(of[t or ""], i))
    return [(i, least.get(of[t or ""])) for i, t in docs]


def test_query_finds_all_classes(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.QUERIES["op3_order_minhash"](spark, sf).collect()
    assert sorted((r.doc_id, r.class_id) for r in rows) == sorted(classes(docs))
    size = Counter(r.class_id for r in rows)
    assert all(r.class_size == size[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=30, unique=True), st.lists(st.integers(0, 9), min_size=1, max_size=30, unique=True))
def test_alignment_is_the_longest_common_order(a, b):
    m = common_order(a, b)
    want = m / (len(a) + len(b) - m)
    for t in (0.3, 0.8):
        got = alignment(np.array(a), np.array(b), t)
        assert abs(got - want) < 1e-12 if want >= t else got == 0.0


def test_sketch_depends_on_order():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    moved = np.concatenate([a[150:], a[:150]])
    assert (order_sketch(a) == order_sketch(a.copy())).all()
    assert (order_sketch(a) == order_sketch(moved)).mean() < 0.6
    assert len(order_sketch(a[:1])) == len(order_sketch(a))


def test_large_group_of_near_copies_and_a_shared_passage(make_docs):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(3000)]
    seed = [rnd.choice(vocab) for _ in range(150)]
    passage = " ".join(rnd.choice(vocab) for _ in range(40))

    def edited():
        w = list(seed)
        w[rnd.randrange(150)] = f"e{rnd.random()}"
        return " ".join(w)

    docs = [(i, edited(), "en", "s") for i in range(150)]
    docs += [(200 + i, " ".join(rnd.choice(vocab) for _ in range(120)) + " " + passage, "en", "s") for i in range(150)]
    docs += [(1000 + i, docs[0][1], "en", "s") for i in range(200)]
    got = {r.doc_id: r.class_id for r in near_duplicates(make_docs(docs)).collect()}
    assert {got[i] for i in range(150)} == {0} and {got[1000 + i] for i in range(200)} == {0}
    assert all(got[200 + i] == 200 + i for i in range(150))
    kept = sorted(r.doc_id for r in deduplicated(make_docs(docs)).collect())
    assert kept == [0] + list(range(200, 350))


def crowd(seed, texts, pairs, passage, own):
    """Texts that begin with the same ``passage`` words (below 0.8); the last 2 * ``pairs`` are near copies in pairs."""
    rnd = random.Random(seed)
    shared = [f"p{i}" for i in range(passage)]
    words = lambda n: [f"u{rnd.random()}" for _ in range(n)]
    tails = [words(own) for _ in range(texts)]
    for _ in range(pairs):
        base = words(own)
        tails += [base, [*base[:5], *words(1), *base[6:11], *words(1), *base[12:]]]
    return [(i, " ".join(shared + t)) for i, t in enumerate(tails)]


def test_near_pairs_inside_a_crowd(make_docs):
    docs = crowd(5, 60, 30, 103, 17)
    docs += [(1000 + i, t.replace("p", "q")) for i, t in crowd(6, 30, 15, 90, 30)]
    got = near_duplicates(make_docs([(i, t, "en", "s") for i, t in docs])).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == sorted(classes(docs))


def test_a_round_without_links_does_not_end_the_search(monkeypatch, make_docs):
    import tessera.llm.near_dedup as m

    nothing = lambda members, *_: members.selectExpr(
        "node as a", "node as b", "node as x", "node as y", "0 as apart").limit(0)
    monkeypatch.setattr(m, "round_pairs", nothing)
    docs = crowd(8, 20, 10, 90, 30)
    got = near_duplicates(make_docs([(i, t, "en", "s") for i, t in docs])).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == sorted(classes(docs))


def test_a_round_with_few_links_is_the_last(monkeypatch, make_docs):
    import tessera.llm.near_dedup as m

    rnd = random.Random(11)
    docs = []
    for i in range(70):
        w = [f"u{rnd.random()}" for _ in range(80)]
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:40], "other", *w[41:]]))]
    turns, plain = [], m.round_pairs

    def rounds(members, labels, turn, threshold):
        """The first round leaves out two links; the second finds one of them."""
        turns.append(turn)
        p = plain(members, None, 1, threshold)
        held = sorted({r.x for r in p.select("x").collect()})[:2]
        return p.filter(~p.x.isin(held)) if turn == 1 else p.filter(p.x == held[0])

    monkeypatch.setattr(m, "round_pairs", rounds)
    got = near_duplicates(make_docs([(i, t, "en", "s") for i, t in docs])).collect()
    assert turns == [1, 2]
    assert sorted((r.doc_id, r.class_id) for r in got) == sorted(classes(docs))
    assert all(r.class_size == 2 for r in got)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**62), max_size=60), st.sets(st.integers(0, 2**62), max_size=60), st.sets(st.integers(0, 2**62), max_size=60))
def test_parities_never_differ_in_more_bits_than_shingles(common, a, b):
    a, b = a | common, b | common
    values = np.array([*a, *b], np.uint64)
    x, y = parities(values, np.array([0, len(a), len(a) + len(b)]))
    bits = sum(bin(int(p) ^ int(q)).count("1") for p, q in zip(x.view(np.uint64), y.view(np.uint64)))
    assert bits <= len(a ^ b)


def test_crowd_of_a_passage_costs_few_alignments(monkeypatch, make_docs):
    import tessera.llm.near_dedup as m

    seen, plain = [], m.verified
    monkeypatch.setattr(m, "verified", lambda pairs, *rest: seen.append(pairs.count()) or plain(pairs, *rest))
    docs = crowd(9, 300, 10, 90, 40)
    got = near_duplicates(make_docs([(i, t, "en", "s") for i, t in docs])).collect()
    assert sum(r.class_size == 2 for r in got) == 20
    assert sum(seen) < 320  # less than one alignment a text


def test_odd_rows(odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    rows = near_duplicates(odd_docs).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)
    assert sorted(((r.doc_id, r.class_id) for r in rows), key=key) == sorted(classes(docs), key=key)
    kept = deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 5, 6, None, 7, 8, 9, 10], key=str)
    assert near_duplicates(no_docs).collect() == [] and deduplicated(no_docs).collect() == []


def test_components_of_paths_stars_and_cycles(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(205, 201), (201, 203), (203, 205)]
    rnd.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[100 + i] for i in range(40)} == {100}
    assert [got[i] for i in (201, 203, 205)] == [201] * 3 and len(got) == 104
