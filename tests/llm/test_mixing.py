import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import queries
from tessera.llm.mixing import mix, schedule

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), share=1.5):
    """Direct rounds of dealing by weight and resharing what is above twice the size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    got, open_, left = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while left > 1e-9 and open_:
        rate, left, over = left / sum(w[s] for s in open_), 0.0, set()
        for s in open_:
            got[s] += rate * w[s]
            if got[s] >= 2 * sizes[s]:
                left, got[s] = left + got[s] - 2 * sizes[s], 2.0 * sizes[s]
                over.add(s)
        open_ -= over
    return got


def laws(rows, docs):
    size = {(d.doc_id, d.source): len(WORD.findall(d.text or "")) for d in docs}
    total = defaultdict(int)
    for d in docs:
        total[d.source] += size[d.doc_id, d.source]
    want = targets(total)
    source = {d.doc_id: d.source for d in docs}
    assert Counter(r.doc_id for r in rows) == Counter(d.doc_id for d in docs)
    taken = Counter()
    for r in rows:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id, s] and r.source_size == total[s]
        assert r.target == pytest.approx(want[s], rel=1e-9, abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in total:
        assert abs(taken[s] - want[s]) <= 0.51


def test_query_meets_targets_and_reruns_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = queries.QUERIES["op5_source_mix"](spark, sf).collect()
    laws(rows, docs)
    assert sorted(rows) == sorted(queries.QUERIES["op5_source_mix"](spark, sf).collect())


def test_schedule_is_low_discrepancy_and_blocks_are_equal(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows, pieces = schedule(docs, bits=10)
    p = pieces.collect()
    src = {r.row: r for r in rows.collect()}
    by_slot = Counter()
    source = {}
    for x in p:
        by_slot[x.slot] += x.to_word - x.from_word
        source[x.slot] = (src[x.row].target, src[x.row].source_size)
        assert 0 <= x.from_word < x.to_word <= src[x.row].size
    for t in set(source.values()):
        mine = [s for s in by_slot if source[s] == t]
        assert max(by_slot[s] for s in mine) - min(by_slot[s] for s in mine) <= 1
    share = Counter(source.values())
    for lo in range(0, 1024, 128):  # each eighth of the schedule has each target's sources in their share
        part = Counter(source[s] for s in by_slot if lo <= s < lo + 128)
        for t, n in share.items():
            assert abs(part[t] - n / 8) <= 0.05 * 128 + 12


def reversed_bits(i, bits):
    return int(format(i, f"0{bits}b")[::-1], 2)


def test_first_slots_follow_van_der_corput_points(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mix(docs, bits=8).collect()
    source = {d.doc_id: d.source for d in docs.collect()}
    total = {s: next(r.target for r in rows if source[r.doc_id] == s) for s in set(source.values())}
    order = sorted(total, key=lambda s: (s is None, s or ""))
    quota = {s: int(total[s] + 0.5) for s in order}
    whole, end, owner = sum(quota.values()), 0, {}
    for s in order:
        lo, end = end, end + quota[s]
        for i in range(256):
            if lo <= i / 256 * whole < end:
                owner[reversed_bits(i, 8)] = s
    filled = [r for r in rows if r.first_slot is not None]
    assert filled and all(r.n_pieces > 0 and owner.get(r.first_slot, source[r.doc_id]) == source[r.doc_id] for r in filled)
    assert all((r.first_slot is None) == (r.taken == 0) == (r.n_pieces == 0) for r in rows)
    by = sorted(filled, key=lambda r: r.first_slot)
    half = Counter(source[r.doc_id] for r in by[:len(by) // 2])
    assert len(half) == len({source[r.doc_id] for r in filled})  # every source appears from the start


def test_odd_rows(odd_docs, no_docs, make_docs):
    laws(mix(odd_docs).collect(), odd_docs.collect())
    assert mix(no_docs).collect() == []
    blank = make_docs([(1, None, "en", None), (2, " ", "en", "a")])
    assert [(r.doc_id, r.taken, r.target) for r in sorted(mix(blank).collect())] == [(1, 0, 0.0), (2, 0, 0.0)]
    tiny = make_docs([(i, "w " * 5000, "en", "big") for i in range(40)] + [(99, "a b", "en", "tiny")])
    laws(mix(tiny, bits=6).collect(), tiny.collect())
