"""The evidence digest: greedy choice by brute force, bounds, and sentences at the far end of long lines."""

import random

from pyspark.sql import functions as F

from tessera.operators import evidence as ev


def brute(pieces, words, budget):
    """The same greedy choice without laziness: every piece is weighed in every step."""
    n = {w: sum(w in ws for ws in words) for ws in words for w in ws}
    chosen, covered, left = [], set(), budget + 1
    while True:
        best = None
        for i, (p, ws) in enumerate(zip(pieces, words)):
            if i not in chosen and len(p) + 1 <= left:
                gain = sum(1000 * len(pieces) // n[w] for w in set(ws) - covered) * 1_000_000 // len(p)
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, i)
        if best is None:
            return "\n".join(pieces[i] for i in sorted(chosen))
        chosen.append(best[1])
        covered |= set(words[best[1]])
        left -= len(pieces[best[1]]) + 1


def test_lazy_greedy_equals_plain_greedy():
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    for _ in range(300):
        words = [[rnd.choice(vocabulary[:rnd.randint(1, 40)]) for _ in range(rnd.randint(0, 8))] for _ in range(rnd.randint(0, 25))]
        pieces = [" ".join(w) or "-" for w in words]
        budget = rnd.choice([0, 5, 40, 120, 10_000])
        got = ev.choose_pieces(pieces, words, budget)
        assert got == brute(pieces, words, budget) and len(got) <= budget


def test_far_sentences_are_read_and_the_budget_holds(spark):
    filler = "The same words come again and again here. " * 60
    rows = [(1, 1, "[a] " + filler + "The decisive harbour opened in nineteen twelve."), (1, 2, "[b] " + filler),
            (2, 1, "short"), (2, 2, "lines"), (3, 1, "x" * 3000), (4, 1, ""), (5, 1, "many words without any end " * 200)]
    lines = spark.createDataFrame(rows, "query_id long, ord long, line string")
    out = {r.query_id: r for r in ev.evidence_text(lines).collect()}
    assert "The decisive harbour opened in nineteen twelve." in out[1].evidence_digest and out[1].needs_digest
    assert out[1].evidence_digest.count("The same words come again") == 2  # once more for the word of its line's mark
    assert out[2].evidence_digest == "short\nlines" and not out[2].needs_digest
    assert out[3].evidence_digest == "x" * 2000  # nothing fits: the first characters
    assert out[4].evidence_digest == "" and out[5].evidence_digest  # a sentence without end is cut into pieces
    assert all(len(r.evidence_digest) <= 2000 for r in out.values())


def test_pieces_hold_every_word(spark):
    text = "One two three. " + "word " * 95 + "\n\nLast   line\twith blanks"
    got = spark.createDataFrame([(text,)], "t string").select(ev.digest_pieces("t").alias("p")).first().p
    assert " ".join(got).split() == text.split()
    assert max(len(p.split()) for p in got) == ev.DIGEST_PIECE_WORDS
    assert spark.createDataFrame([("",)], "t string").select(F.size(ev.digest_pieces("t"))).first()[0] == 0
