"""Risk-controlled quality rules: cutoffs certified on labelled holdouts.

Each rule rejects a text whose feature exceeds a cutoff. A step sharpens one rule to one cutoff of a
fixed grid; the steps taken so far form a rule set, so the sets of a sequence are nested. Per stratum
(language) a sequence of steps is fixed before its labels are read, and its sets are tested one after
the other: a set is certified if the exact binomial test on the stratum's labelled good texts shows,
at the corrected level, that all its rules together reject at most ``risk`` of the good texts. The
sequence stops at the first failure, so one level serves all its steps; the level is divided by the
number of strata (Bonferroni). With probability 1 - ``level`` every stratum loses at most ``risk`` of
its good texts. A stratum with too few labels gets no cutoff (at four strata, 217 good ones are
needed).

The order of a stratum's steps is learnt from the labels of the other strata only, so it does not
depend on the labels that test it: steps come by the ratio of good to bad texts they reject there, and
those that do not reject bad texts ``GAIN`` times as often as good ones are left out. If the other strata have
fewer than ``LEAST`` good or bad labels, the order is that of the grid, from the laxest cutoffs on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Prefix, Words, blocks, col, materialize, mix, occurrence, text_bytes

RISK, LEVEL = 0.02, 0.05
#: A learnt step rejects bad texts at least GAIN times as often as good ones; learning takes LEAST labels of each.
GAIN, LEAST = 2.0, 30
#: rule -> ascending cutoffs; the last one is the laxest.
GRID = {
    "symbol_ratio": (0.02, 0.03, 0.05, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5),
    "upper_ratio": (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9),
    "mark_ratio": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9),
    "digit_ratio": (0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.4, 0.5, 0.7),
    "dup_line_ratio": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75),
    "repeat_ratio": (0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.18),
    "lone_symbol_ratio": (0.01, 0.02, 0.04, 0.06, 0.1, 0.15, 0.2, 0.3, 0.5),
    "word_length": (8.0, 9.0, 10.0, 12.0, 14.0, 17.0, 20.0, 30.0, 50.0),
}
RULES = tuple(GRID)
#: All steps in the order of the grid: every rule's laxest cutoff, then every rule's next one.
STEPS = tuple((r, c) for cs in zip(*[tuple(zip([r] * len(GRID[r]), GRID[r][::-1])) for r in RULES]) for r, c in cs)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


_SYMBOL, _MARK, _DIGIT = _table("#*$%&|<>"), _table("!?"), _table("0123456789")
_UPPER, _LOWER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz")


def _per(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of true bytes of each text."""
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[off])


def block_features(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Base counts and rule features of every text of a block."""
    w = Words(data, off)
    n_docs = len(off) - 1
    lead = (data & 0xC0) != 0x80
    blank = np.zeros(len(data) + 1, np.int64)
    np.add.at(blank, w.start, 1)
    np.add.at(blank, w.end, -1)
    inside = np.cumsum(blank)[:-1] > 0
    chars, symbols = _per(inside & lead, off), _per(_SYMBOL[data], off)

    # Lines: every text is cut at \n; a text ends its last line.
    nl = np.flatnonzero(data == 10)
    start, end = np.sort(np.concatenate([off[:-1], nl + 1])), np.sort(np.concatenate([nl, off[1:]]))
    full = np.searchsorted(w.start, end, "left") > np.searchsorted(w.start, start, "left")
    start, end = start[full], end[full]
    line_first = np.searchsorted(start, off, "left")
    lines = np.diff(line_first)
    dup = occurrence(Prefix(data)(start, end), line_first) > 0
    dups = np.diff(np.concatenate([[0], np.cumsum(dup)])[line_first])

    # Five-word windows found twice or more in the text, and the words they cover.
    sh, first = w.shingles(5)
    run = np.repeat(np.arange(n_docs, dtype=np.uint64), np.diff(first))
    _, at, n = np.unique(mix(sh + run * np.uint64(0xD6E8FEB86659FD93)), return_inverse=True, return_counts=True)
    hit = n[at] > 1 if len(at) else np.zeros(0, bool)
    left = (np.arange(len(sh)) - np.repeat(first[:-1] - w.first[:-1], np.diff(first)))[hit]
    cover = np.zeros(len(w.start) + 6, np.int64)
    np.add.at(cover, left, 1)
    np.add.at(cover, left + 5, -1)
    covered = np.cumsum(cover)[:len(w.start)] > 0
    repeat = np.diff(np.concatenate([[0], np.cumsum(covered)])[w.first])

    lone = (w.end - w.start == 1) & _SYMBOL[data[w.start]]
    lone = np.diff(np.concatenate([[0], np.cumsum(lone)])[w.first])
    upper, lower = _per(_UPPER[data], off), _per(_LOWER[data], off)
    words = np.maximum(w.counts, 1)
    return {"n_words": w.counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dups,
            "n_repeat_words": repeat,
            "symbol_ratio": symbols / np.maximum(chars, 1), "upper_ratio": upper / np.maximum(upper + lower, 1),
            "mark_ratio": _per(_MARK[data], off) / words, "digit_ratio": _per(_DIGIT[data], off) / np.maximum(chars, 1),
            "dup_line_ratio": dups / np.maximum(lines, 1), "repeat_ratio": repeat / words,
            "lone_symbol_ratio": lone / words, "word_length": chars / words}


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, stratum, base counts, rule features) of whole texts; null, empty and blank texts have all 0."""

    def run(batches):
        for batch, texts in blocks(batches):
            f = block_features(*text_bytes(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(f[c].astype(np.int64)) for c in BASE],
                 *[pa.array(f[c].astype(np.float64)) for c in RULES]], names=["doc_id", "stratum", *BASE, *RULES])

    schema = ", ".join(["doc_id long", "stratum string", *[f"{c} long" for c in BASE], *[f"{c} double" for c in RULES]])
    return docs.select(col(id_col).cast("long").alias("doc_id"), col(stratum_col).cast("string").alias("stratum"),
                       col(text_col).alias("text")).mapInArrow(run, schema)


def binomial_cdf(x: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= x), exact up to rounding: the p-value of "the rate is above p"."""
    if x >= n:
        return 1.0
    k = np.arange(0, x + 1)
    logs = (math.lgamma(n + 1) - np.array([math.lgamma(i + 1) + math.lgamma(n - i + 1) for i in k])
            + k * math.log(p) + (n - k) * math.log1p(-p))
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def sequence(good: int, bad: int, good_out: list[int], bad_out: list[int]) -> list[int]:
    """Indexes of STEPS in testing order, learnt from the texts each step alone rejects elsewhere.

    ``good`` and ``bad`` are the labelled texts elsewhere, ``good_out`` and ``bad_out`` what each step
    rejects of them. Rates are smoothed by one text; equal ratios keep the order of the grid.
    """
    if good < LEAST or bad < LEAST:
        return list(range(len(STEPS)))
    ratio = [(g + 1) / (good + 2) / ((b + 1) / (bad + 2)) for g, b in zip(good_out, bad_out)]
    return sorted((k for k in range(len(STEPS)) if ratio[k] * GAIN <= 1), key=lambda k: (ratio[k], k))


def certified(n: int, rejected: list[int], risk: float, level: float) -> int:
    """Number of steps certified: ``rejected[j]`` of ``n`` good texts fall to the first j + 1 steps together."""
    for j, x in enumerate(rejected):
        if x > n * risk or binomial_cdf(x, n, risk) > level:
            return j
    return len(rejected)


def thresholds(feats: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL, id_col: str = "doc_id",
               label_col: str = "quality") -> DataFrame:
    """One row per stratum: n_good, n_rejected of them by the certified set, and its cutoff of each rule (null: none).

    Labelled rows that pass the base rules count: the good ones of a stratum test its sequence, the others'
    good and bad ones order it. An id labelled twice counts once, as good only if always good; null ids or
    labels do not count.
    """
    known = (labels.select(col(id_col).cast("long").alias("doc_id"), col(label_col).alias("q"))
             .filter("doc_id is not null and q is not null").groupBy("doc_id").agg((F.min("q") == 1).alias("good")))
    held = materialize(feats.filter(~base_failed()).join(known, "doc_id"), "quality-labelled")
    out = lambda good: F.array(*[F.count(F.when((F.col("good") == good) & (F.col(r) > c), 1)) for r, c in STEPS])
    per = materialize(held.groupBy("stratum").agg(F.count(F.when(F.col("good"), 1)).alias("n_good"),
                                                  F.count(F.when(~F.col("good"), 1)).alias("n_bad"),
                                                  out(True).alias("good_out"), out(False).alias("bad_out")), "quality-strata")
    # One row of fixed length: the labels of all strata together.
    sums = lambda c: F.array(*[F.coalesce(F.sum(F.col(c)[k]), F.lit(0)) for k in range(len(STEPS))]).alias(c)
    every = per.agg(F.count(F.when(F.col("n_good") > 0, 1)).alias("strata"), F.sum("n_good").alias("good"),
                    F.sum("n_bad").alias("bad"), sums("good_out"), sums("bad_out")).first()

    def ordered(batches):
        for b in batches:
            steps = [sequence((every["good"] or 0) - x["n_good"], (every["bad"] or 0) - x["n_bad"],
                              [t - o for t, o in zip(every["good_out"], x["good_out"])],
                              [t - o for t, o in zip(every["bad_out"], x["bad_out"])]) for x in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(steps, pa.list_(pa.int32()))],
                                             names=["s", "n_good", "steps"])

    orders = materialize(per.mapInArrow(ordered, "s string, n_good long, steps array<int>"), "quality-orders")
    # The first step of its stratum's sequence that rejects a good text (array_position: 0 if left out).
    at = [F.when(F.col(r) > c, F.nullif(F.array_position("steps", F.lit(k)), F.lit(0))) for k, (r, c) in enumerate(STEPS)]
    falls = (held.filter("good").join(orders, F.col("stratum").eqNullSafe(F.col("s")))
             .select("s", F.least(*at).alias("step")).filter("step is not null")
             .groupBy("s", "step").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("s").agg(F.collect_list(F.struct("step", "n")).alias("falls")).withColumnRenamed("s", "fs"))

    def certify(batches):
        for b in batches:
            cuts, lost = [], []
            for x in b.to_pylist():
                new = np.zeros(len(x["steps"]), np.int64)
                for f in x["falls"] or []:
                    new[f["step"] - 1] += f["n"]
                upto = np.cumsum(new).tolist()
                done = certified(x["n_good"], upto, risk, level / max(1, every["strata"]))
                taken = [STEPS[k] for k in x["steps"][:done]]
                cuts.append({r: min((c for q, c in taken if q == r), default=None) for r in RULES})
                lost.append(upto[done - 1] if done else 0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(lost, pa.int64()),
                 *[pa.array([c[r] for c in cuts], pa.float64()) for r in RULES]],
                names=["stratum", "n_good", "n_rejected", *RULES])

    schema = ", ".join(["stratum string", "n_good long", "n_rejected long", *[f"{r} double" for r in RULES]])
    return (orders.join(falls, F.col("s").eqNullSafe(F.col("fs")), "left").select("s", "n_good", "steps", "falls")
            .mapInArrow(certify, schema))


def base_failed():
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL, id_col: str = "doc_id",
          text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, base counts, base_failed, kept, rule), one row per input row; rule: the first certified rule that fires.

    A null stratum is a stratum of its own. Null, empty and blank texts fail the base rules; very long texts
    are judged whole. A feature equal to its cutoff passes (ties stay). With no labels nothing is certified
    and only the base rules reject. Repeated rows are judged alike; an empty table gives no rows; other
    columns are not read.
    """
    f = materialize(features(docs, id_col, text_col, stratum_col), "quality-features")
    cut = thresholds(f, labels, risk, level).select(F.col("stratum").alias("s"),
                                                    *[F.col(r).alias(f"cut_{r}") for r in RULES])
    j = f.join(cut, F.col("stratum").eqNullSafe(F.col("s")), "left")
    rule = F.coalesce(*[F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES])
    j = j.withColumn("rule", rule).withColumn("base_failed", base_failed())
    return j.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
