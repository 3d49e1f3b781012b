"""Benchmark decontamination: size-partitioned MinHash containment search, exactly verified.

Test items are partitioned by their number of five-word shingles, a partition holding
(L / 2, L]. For each partition a document is cut into windows of 2 L shingles, every L, so
an item lies whole in some window and its Jaccard similarity with that window is at least about
0.19 where its containment is 0.8; ``HASHES`` minima of each window are looked up among the items'
minima, one shared minimum being enough. Candidates are verified by exact containment:
the share of the item's distinct shingles that the whole document holds.

Documents are read once and never exchanged. Items come in blocks of proven size, each broadcast;
more items mean more blocks, chained over the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Words, col, map_texts, materialize, mix, text_bytes, unpacked

SHINGLE = 5
THRESHOLD = 0.8
#: A window at Jaccard 0.19 shares none of 64 minima with probability 1e-6.
HASHES = 64
#: Most items and bytes of item text in one broadcast block.
BLOCK_ITEMS, BLOCK_TEXT = 20_000, 32 << 20
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = mix(_SEEDS) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FILTER_BITS = 22


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, offsets of the texts) of words with A-Z lowered; texts under five words have none."""
    data, off = text_bytes(texts)
    w = Words(_LOWER[data], off)
    sh, first = w.shingles(SHINGLE)
    n = np.diff(first)
    keep = np.repeat(w.counts >= SHINGLE, n)
    return sh[keep], np.concatenate([[0], np.cumsum(np.where(w.counts >= SHINGLE, n, 0))]).astype(np.int64)


class Items:
    """One block of items: distinct shingles, and per size partition the sorted keys of their minima."""

    def __init__(self, ids: list[int], texts: list[str]):
        sh, first = shingles(pa.array(texts, pa.string()))
        self.sets = [np.unique(sh[a:z]) for a, z in zip(first[:-1], first[1:])]
        self.ids = ids
        self.parts: dict[int, tuple] = {}
        by_size: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                by_size.setdefault(1 << int(len(s) - 1).bit_length(), []).append(i)
        for size, mine in sorted(by_size.items()):
            low = np.stack([((self.sets[i][None, :] ^ _SEEDS[:, None]) * _ODD[:, None]).min(axis=1) for i in mine])
            keys, owner = self.keyed(low).ravel(), np.repeat(np.array(mine), HASHES)
            order = np.argsort(keys, kind="stable")
            sieve = np.zeros(1 << _FILTER_BITS, bool)
            sieve[keys >> np.uint64(64 - _FILTER_BITS)] = True
            self.parts[size] = (keys[order], owner[order], sieve)

    @staticmethod
    def keyed(minima: np.ndarray) -> np.ndarray:
        """Minima of different hashes told apart: one key per (hash, minimum)."""
        return mix(minima + _SEEDS[None, :])

    def candidates(self, sh: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (text, item) pairs that share a minimum of a window."""
        n = np.diff(first)
        found = []
        if len(sh):
            # Minima of blocks of the least size; larger blocks are pairs of smaller ones.
            size, minima = 0, None
            for want, (keys, owner, sieve) in self.parts.items():
                if minima is None:
                    size, count = want, -(-n // want)
                    at = np.repeat(first[:-1], count) + want * (np.arange(count.sum())
                                                                - np.repeat(np.cumsum(count) - count, count))
                    minima = np.stack([np.minimum.reduceat((sh ^ s) * o, at) for s, o in zip(_SEEDS, _ODD)], axis=1)
                while size < want:
                    half = -(-count // 2)
                    at = (np.repeat(np.cumsum(count) - count, half)
                          + 2 * (np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half)))
                    minima, count, size = np.minimum.reduceat(minima, at, axis=0), half, 2 * size
                text = np.repeat(np.arange(len(n)), count)
                window = minima.copy()
                next_same = np.flatnonzero(text[1:] == text[:-1])
                window[next_same] = np.minimum(minima[next_same], minima[next_same + 1])
                k = self.keyed(window)
                row, h = np.nonzero(sieve[k >> np.uint64(64 - _FILTER_BITS)])
                k = k[row, h]
                a, z = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
                for t, x, y in zip(text[row[z > a]], a[z > a], z[z > a]):
                    found.append(np.stack([np.full(y - x, t), owner[x:y]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def matches(self, texts: pa.Array, threshold: float) -> list[tuple[int, int, float]]:
        """(text, item id, containment) of verified pairs, by text."""
        sh, first = shingles(texts)
        out, last, own = [], -1, None
        for t, i in self.candidates(sh, first).tolist():
            if t != last:
                last, own = t, np.unique(sh[first[t]:first[t + 1]])
            item = self.sets[i]
            at = np.minimum(np.searchsorted(own, item), len(own) - 1)
            share = float(np.count_nonzero(own[at] == item)) / len(item)
            if share >= threshold:
                out.append((t, self.ids[i], share))
        return out


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = BLOCK_ITEMS,
                most_bytes: int = BLOCK_TEXT) -> list[DataFrame]:
    """Blocks of (item, text) with at most ``most`` items, and as many more as the bytes ask for."""
    b = benchmark.select(col(id_col).cast("long").alias("item"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    b = materialize(b.filter("item is not null").withColumn("row", F.monotonically_increasing_id()), "items")
    n, size = b.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(-(-n // (most // 2 or 1)), -(-size // (most_bytes // 2)), 1)
    if n <= most and size <= most_bytes:
        return [b]
    return [b.filter(F.pmod(F.xxhash64("row"), F.lit(parts)) == i) for i in range(parts)]


def _loaded(spark: SparkSession, block: DataFrame):
    rows = block.orderBy("item", "row").select("item", "text").collect()  # one block, of checked size
    return spark.sparkContext.broadcast(Items([r["item"] for r in rows], [r["text"] for r in rows]))


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD,
                  most: int = BLOCK_ITEMS, keep: list[str] | None = None) -> DataFrame:
    """(doc struct, n_items, best_item, containment): per document the test items it contains.

    best_item has the greatest containment, of equal ones the least id; null and 0.0 without a
    match. Null and empty texts, and texts or items of under five words, match nothing; an item
    id given twice counts as often as it matches; null item ids are not searched. Empty tables on
    either side give no matches. Rows are neither exchanged nor lost.
    """
    columns = [text_col, *[c for c in (keep if keep is not None else docs.columns) if c != text_col]]
    out = None
    for block in item_blocks(benchmark, most=most):
        items = _loaded(docs.sparkSession, block)

        def found(texts, items=items):
            n, best, share = np.zeros(len(texts), np.int64), [None] * len(texts), np.zeros(len(texts))
            for t, item, s in items.value.matches(texts, threshold):
                n[t] += 1
                if best[t] is None or (-s, item) < (-share[t], best[t]):
                    best[t], share[t] = item, s
            return [pa.array(n), pa.array(best, pa.int64()), pa.array(share)]

        if out is None:
            out = map_texts(docs, text_col, found, "n_items long, best_item long, containment double", columns)
            continue
        more = map_texts(out.select("doc.*", *[F.col(c).alias(f"{c} before") for c in ("n_items", "best_item", "containment")]),
                         text_col, found, "n_items long, best_item long, containment double")
        was = lambda c: F.col("doc").getField(f"{c} before")
        better = F.col("best_item").isNotNull() & (was("best_item").isNull() | (F.col("containment") > was("containment")) | (
            (F.col("containment") == was("containment")) & (F.col("best_item") < was("best_item"))))
        out = more.select(F.struct(*[F.col("doc").getField(c).alias(c) for c in columns]).alias("doc"),
                          (F.col("n_items") + was("n_items")).alias("n_items"),
                          F.when(better, F.col("best_item")).otherwise(was("best_item")).alias("best_item"),
                          F.when(better, F.col("containment")).otherwise(was("containment")).alias("containment"))
    return out


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_items, best_item, containment, contaminated), one row per input row."""
    c = contamination(docs, benchmark, text_col, threshold, keep=[id_col])
    return c.select(F.col("doc").getField(id_col).cast("long").alias("doc_id"), "n_items", "best_item", "containment",
                    (F.col("n_items") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no test item."""
    return unpacked(contamination(docs, benchmark, text_col, threshold).filter("n_items = 0"), docs.columns)
