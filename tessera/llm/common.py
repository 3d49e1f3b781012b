"""Shared helpers: materialised tables, packed rows, and words of whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import scratch_dir

#: Bytes of text handled at once inside a task; one longer document is handled alone.
BLOCK_BYTES = 1 << 20

#: Word pattern of the contract, as a Spark (Java) regular expression.
WORD_RE = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts the lineage with a file that outlives executors, and makes every later use see the
    same rows. The folder is the one named by ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def col(name: str):
    """Column by its exact name (dots and blanks are part of the name)."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, *exprs) -> DataFrame:
    """(doc struct with every column, *exprs): extra columns never clash with an operator's own."""
    return docs.select(F.struct(*[col(c) for c in docs.columns]).alias("doc"), *exprs)


def unpacked(df: DataFrame, columns: list[str], *out: str) -> DataFrame:
    """The packed columns again, followed by ``out``; an input column named like one of ``out`` gives way."""
    return df.select(*[F.col("doc").getField(c).alias(c) for c in columns if c not in out], *out)


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text",
           limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut Arrow batches into runs of whole rows of about ``limit`` bytes of text; null texts become empty."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        t = batch.column(batch.schema.get_field_index(text))
        if t.null_count:
            t = pc.fill_null(t, "")
        total = np.cumsum(pc.binary_length(t).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < batch.num_rows:
            done = int(total[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(total, done + limit, "right")))
            yield batch.slice(i, j - i), t.slice(i, j - i)
            i = j


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of n + 1 texts) without copying the Arrow buffers."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    _, o, d = texts.buffers()
    off = np.frombuffer(o, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    off = off.astype(np.int64)
    data = np.frombuffer(d, np.uint8)[off[0]:off[-1]] if d is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64, kept per worker up to 4 blocks."""
    if len(_POWERS[0]) > n:
        return _POWERS[0], _POWERS[1]
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    if n <= 4 * BLOCK_BYTES:
        _POWERS[:] = [up, down]
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (the finaliser of a public-domain hash)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Prefix:
    """Hash of any byte range of a block in constant time (polynomial modulo 2**64, then mixed)."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


class Words:
    """Words (runs of bytes other than the six ASCII blanks) of every text of a block.

    ``start``/``end``: byte ranges, ``doc``: index of the text, ``first``: n + 1 offsets of the
    texts' words, ``hash``: 64 bits per word.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        solid = ~_SPACE[data]
        begin, stop = solid.copy(), solid.copy()
        if len(data):
            begin[1:] &= ~solid[:-1]
            stop[:-1] &= ~solid[1:]
            full = off[1:] > off[:-1]
            a, z = off[:-1][full], off[1:][full] - 1
            begin[a], stop[z] = solid[a], solid[z]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, off, "left")
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(off) - 1), self.counts)
        self.hash = Prefix(data)(self.start, self.end)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, n + 1 offsets) of all k-word windows; a text of 1 to k - 1 words has one, of all its words."""
        n_words = self.counts
        n = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
        first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        at = np.arange(first[-1]) - np.repeat(first[:-1] - self.first[:-1], n)
        left = np.repeat(n_words, n)
        h = np.zeros(len(at), np.uint64)
        padded = np.concatenate([self.hash, np.zeros(k, np.uint64)])
        with np.errstate(over="ignore"):
            for j in range(k):
                w = padded[at + j]
                h = h * _BASE + (w if j == 0 else np.where(left > j, w, np.uint64(0)))
        return mix(h), first


def occurrence(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... for equal values inside each run ``first[i]:first[i + 1]``, in order of position."""
    if not len(values):
        return np.zeros(0, np.int64)
    run = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    key = mix(values + run * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    start = np.flatnonzero(new)
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - np.repeat(start, np.diff(np.concatenate([start, [len(values)]])))
    return out


def map_texts(docs: DataFrame, text_col: str, fn, out: str, keep: list[str] | None = None) -> DataFrame:
    """(doc struct, *out): ``fn(texts)`` gives the new columns of a block of whole texts; nothing is exchanged.

    ``out`` is a DDL string of the new columns; ``fn`` returns their Arrow arrays in that order.
    """
    columns = [text_col, *[c for c in (keep if keep is not None else docs.columns) if c != text_col]]
    rows = docs.select(F.struct(*[col(c) for c in columns]).alias("doc"))
    added = T.StructType.fromDDL(out)
    schema = T.StructType([T.StructField("doc", rows.schema["doc"].dataType), *added.fields])

    def run(batches):
        for batch in batches:
            doc = batch.column(0)
            texts = doc.flatten()[0] if batch.num_rows else pa.array([], pa.string())
            both = pa.RecordBatch.from_arrays([doc, texts], names=["doc", "text"])
            for part, t in blocks([both]):
                yield pa.RecordBatch.from_arrays([part.column(0), *fn(t)], names=schema.names)

    return rows.mapInArrow(run, schema)
