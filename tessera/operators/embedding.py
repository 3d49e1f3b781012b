"""Embedding and vector-table operators.

The default embedder is a hashed character-trigram count vector; any other model plugs in
through :class:`PandasEmbedder`, an Arrow-batched iterator UDF that loads the model once per
Python worker. Both embed in place (no shuffle): a vector is a function of its text only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as tx
from tessera.functions import vectors as vx


#: Characters and texts that are counted at a time; vectors leave a task in batches of so many texts, too.
PIECE_CHARS, PIECE_TEXTS = 1 << 18, 4096


def _cut_rows(arr: pa.Array, rows: int) -> Iterator[pa.Array]:
    for s in range(0, len(arr), rows):
        yield arr.slice(s, rows)


def _cut_lists(arr: pa.ListArray, entries: int) -> Iterator[pa.ListArray]:
    """Runs of rows with at most ``entries`` list entries; a longer row is a run of its own."""
    ends, s = arr.offsets.to_numpy(), 0
    while s < len(arr):
        e = max(s + 1, int(np.searchsorted(ends, ends[s] + entries, side="right")) - 1)
        yield arr.slice(s, e - s)
        s = e


def _texts(arr: pa.Array) -> Iterator[str | None]:
    for part in _cut_rows(arr, 256):
        yield from part.to_pylist()


def _list_sims(embed: Callable[[Iterator[str | None], int], np.ndarray], dim: int) -> Callable[[pa.ListArray], Iterator[pa.ListArray]]:
    """``sims(lists of texts)``, in parts: per list, the cosine of each text with the one before it (null for the first).

    For use inside a Python worker, where the vectors stay: ``embed`` gets ``PIECE_TEXTS`` texts at a time. Sums
    run in the order of the vectors' entries, so cosines equal those of :func:`vectors.cosine_similarity`.
    """
    def sums(x: np.ndarray) -> np.ndarray:
        return np.add.accumulate(x, axis=1)[:, -1]

    def sims(arr: pa.ListArray) -> Iterator[pa.ListArray]:
        arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
        arr = arr.fill_null(pa.scalar([], arr.type)) if arr.null_count else arr
        for part in _cut_lists(arr, PIECE_TEXTS):
            flat, ends = part.flatten(), part.offsets.to_numpy()
            ends = ends - ends[0]
            out, last = np.zeros(len(flat)), np.zeros((1, dim))
            for s in range(0, len(flat), PIECE_TEXTS):  # a list longer than a piece goes on from its last vector
                piece = flat.slice(s, PIECE_TEXTS)
                m = np.vstack([last, embed(_texts(piece), len(piece))])
                sq = sums(m * m)
                np.divide(sums(m[:-1] * m[1:]), np.sqrt(sq[:-1]) * np.sqrt(sq[1:]), out=out[s:s + len(piece)],
                          where=(sq[:-1] != 0) & (sq[1:] != 0))
                last = m[-1:]
            first = np.zeros(len(flat), dtype=bool)
            first[ends[:-1][ends[:-1] < ends[1:]]] = True
            yield pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(out, mask=first))

    return sims


def neighbour_sims(texts, embedder) -> Column:
    """``array<string>`` -> ``array<double>``: the embedder's ``list_sims`` as a column; one number per text leaves the worker."""
    mk = embedder.list_sims

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def _sims(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sims = mk()
        for arr in batches:
            yield from sims(arr)

    return _sims(tx._col(texts))


def normalized_for_trigrams(text) -> Column:
    """`' ' + collapse(lower(text)) + ' '`."""
    return F.concat(F.lit(" "), tx.strip(tx.collapse_ws(F.lower(tx._col(text)))), F.lit(" "))


class HashedTrigramEmbedder:
    """Character trigrams of the padded lower-cased text, md5-bucketed into ``dim`` counts.

    Bucket of a trigram = first two hex digits of its md5 read as a number, modulo ``dim``.
    Vectors are whole-number counts, so dot products are exact in any summation order.

    Evaluated as an Arrow-batched pandas UDF inside the row's partition (no shuffle): each
    Python worker keeps a bounded trigram -> bucket cache, so md5 runs once per distinct
    trigram per worker. A pure-SQL form (:meth:`vector_sql`) gives the same numbers and is
    what the DuckDB twins use.
    """

    CACHE_LIMIT = 1 << 20

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.name = f"hashed-trigram-{dim}"

    @staticmethod
    def _counter(dim: int, limit: int):
        """``counts(n texts) -> (n, dim)``, in pieces of bounded size.

        Texts are normalised, padded and concatenated up to ``PIECE_CHARS`` characters or ``PIECE_TEXTS``
        texts; a longer text is cut into overlapping slices whose counts add up. Every trigram of a piece
        becomes one int64 code (three 21-bit code points); the bucket of each distinct code comes from a
        sorted per-worker cache (md5 only for codes not seen before), and one ``bincount`` over
        (text, bucket) gives the piece's vectors. The Python work is per distinct new trigram, not
        per character, and the memory beside the result is that of one piece.
        """
        import hashlib

        state = {"codes": np.zeros(0, dtype=np.int64), "buckets": np.zeros(0, dtype=np.int64)}

        def bucket_of(code: int) -> int:
            g = chr(code >> 42) + chr((code >> 21) & 0x1FFFFF) + chr(code & 0x1FFFFF)
            return int(hashlib.md5(g.encode("utf-8")).hexdigest()[:2], 16) % dim

        def lookup(codes: np.ndarray) -> np.ndarray:
            uniq, inv = np.unique(codes, return_inverse=True)
            known, kb = state["codes"], state["buckets"]
            pos = np.searchsorted(known, uniq)
            hit = (pos < len(known)) & (known[np.minimum(pos, max(len(known) - 1, 0))] == uniq) if len(known) \
                else np.zeros(len(uniq), dtype=bool)
            ub = np.empty(len(uniq), dtype=np.int64)
            ub[hit] = kb[pos[hit]]
            new = uniq[~hit]
            if len(new):
                nb = np.fromiter((bucket_of(int(c)) for c in new), dtype=np.int64, count=len(new))
                ub[~hit] = nb
                if len(known) + len(new) > limit:
                    known, kb = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
                allc = np.concatenate([known, new])
                allb = np.concatenate([kb, nb])
                order = np.argsort(allc, kind="stable")
                state["codes"], state["buckets"] = allc[order], allb[order]
            return ub[inv]

        def piece(padded: list[str]) -> np.ndarray:
            n = len(padded)
            lens = np.fromiter((len(p) for p in padded), dtype=np.int64, count=n)
            cps = np.frombuffer("".join(padded).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
            owner = np.repeat(np.arange(n), lens)
            local = np.arange(len(cps)) - np.repeat(np.cumsum(lens) - lens, lens)
            idx = np.nonzero(local < np.repeat(lens - 2, lens))[0]
            codes = (cps[idx] << 42) | (cps[idx + 1] << 21) | cps[idx + 2]
            b = lookup(codes)
            return np.bincount(owner[idx] * dim + b, minlength=n * dim).reshape(n, dim)

        def counts(texts, n: int) -> np.ndarray:
            out = np.zeros((n, dim))
            at, held, size = [], [], 0
            for i, t in enumerate(texts):
                p = " " + " ".join(t.lower().split()) + " " if t is not None else ""
                for s in range(0, len(p) - 2, PIECE_CHARS):
                    held.append(p[s:s + PIECE_CHARS + 2])
                    at.append(i)
                    size += len(held[-1])
                    if size >= PIECE_CHARS or len(held) >= PIECE_TEXTS:
                        out[at] += piece(held)  # a cut text fills a piece, so it is in one but once
                        at, held, size = [], [], 0
            if held:
                out[at] += piece(held)
            return out

        return counts

    def vector(self, text) -> Column:
        dim, limit, mk = self.dim, self.CACHE_LIMIT, self._counter

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def _tri(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            counts = mk(dim, limit)
            for arr in batches:
                for part in _cut_rows(arr, PIECE_TEXTS):
                    m = counts(_texts(part), len(part))
                    offsets = pa.array(np.arange(len(m) + 1, dtype=np.int32) * dim)
                    yield pa.ListArray.from_arrays(offsets, pa.array(m.ravel()))

        return _tri(tx._col(text))

    def flat_vectors(self, texts) -> Column:
        """``array<string>`` -> one flat ``array<double>`` (len(texts) * dim) per row.

        A flat array per row moves through Arrow far cheaper than an array of arrays; cut it
        with :func:`unflatten` in a later projection (a Python UDF cannot sit inside a lambda).
        """
        dim, limit, mk = self.dim, self.CACHE_LIMIT, self._counter

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def _tri_flat(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            counts = mk(dim, limit)
            for arr in batches:
                # list<string> -> one flat list of segments; the output row i holds the vectors
                # of its own segments, so the list offsets are the input offsets times dim.
                arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
                arr = arr.fill_null(pa.scalar([], arr.type)) if arr.null_count else arr
                for part in _cut_lists(arr, PIECE_TEXTS):
                    flat, ends = part.flatten(), part.offsets.to_numpy()
                    m = counts(_texts(flat), len(flat))
                    offsets = pa.array((ends - ends[0]) * dim, type=pa.int32())
                    yield pa.ListArray.from_arrays(offsets, pa.array(m.ravel()))

        return _tri_flat(tx._col(texts))

    def list_sims(self) -> Callable[[pa.ListArray], Iterator[pa.ListArray]]:
        return _list_sims(self._counter(self.dim, self.CACHE_LIMIT), self.dim)

    def vectors(self, texts) -> Column:
        dim, limit, mk = self.dim, self.CACHE_LIMIT, self._counter

        @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
        def _tri_many(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            counts = mk(dim, limit)
            for s in batches:
                lists = [list(x) if x is not None else [] for x in s]
                m = counts((t for x in lists for t in x), sum(map(len, lists)))
                out, at = [], 0
                for x in lists:
                    out.append(list(m[at:at + len(x)]))
                    at += len(x)
                yield pd.Series(out)

        return _tri_many(tx._col(texts))

    def vector_sql(self, text) -> Column:
        """The same vector as a pure Spark SQL expression (slower: interpreted lambdas)."""
        dim = self.dim
        padded = normalized_for_trigrams(text)

        def from_padded(p):
            n = F.length(p) - 2
            pos = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
            ids = F.transform(pos, lambda i: F.conv(F.substring(F.md5(F.substring(p, i, 3)), 1, 2), 16, 10)
                              .cast("int") % F.lit(dim))
            return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                               lambda b: F.size(F.filter(ids, lambda x: x == b)).cast("double"))

        return vx.let(padded, from_padded)

    def embed(self, df: DataFrame, text_col: str, key_cols: Sequence[str], out_col: str = "vec") -> DataFrame:
        return df.select(*key_cols, self.vector(F.col(text_col)).alias(out_col))


class PandasEmbedder:
    """Pluggable model: ``load()`` returns ``encode(list[str]) -> ndarray (n, dim)``.

    The model is loaded once per Python worker (iterator pandas UDF, Arrow batches); a batch
    that fails is retried text by text and a text that still fails gets the zero vector, so
    no row is lost.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int, name: str):
        self.load, self.dim, self.name = load, dim, name

    def _encode_all(self, encode, texts: list[str]) -> np.ndarray:
        dim = self.dim
        try:
            return np.asarray(encode(texts), dtype=np.float64).reshape(len(texts), dim)
        except Exception:
            rows = []
            for t in texts:
                try:
                    rows.append(np.asarray(encode([t]), dtype=np.float64).reshape(dim))
                except Exception:
                    rows.append(np.zeros(dim))
            return np.vstack(rows) if rows else np.zeros((0, dim))

    def vector(self, text) -> Column:
        load, enc = self.load, self._encode_all

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = load()
            for s in batches:
                yield pd.Series(list(enc(encode, s.fillna("").tolist())))

        return _embed(tx._col(text))

    def vectors(self, texts) -> Column:
        load, enc = self.load, self._encode_all

        @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
        def _embed_many(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encode = load()
            for s in batches:
                lists = [list(x) if x is not None else [] for x in s]
                flat = [t or "" for x in lists for t in x]
                m = enc(encode, flat) if flat else np.zeros((0, self.dim))
                out, at = [], 0
                for x in lists:
                    out.append(list(m[at:at + len(x)]))
                    at += len(x)
                yield pd.Series(out)

        return _embed_many(tx._col(texts))

    def list_sims(self) -> Callable[[pa.ListArray], Iterator[pa.ListArray]]:
        encode, enc = self.load(), self._encode_all
        return _list_sims(lambda texts, n: enc(encode, [t or "" for t in texts]), self.dim)

    def embed(self, df: DataFrame, text_col: str, key_cols: Sequence[str], out_col: str = "vec") -> DataFrame:
        return df.select(*key_cols, self.vector(F.col(text_col)).alias(out_col))


def unflatten(flat, n, dim: int) -> Column:
    """Cut a flat ``array<double>`` into ``n`` vectors of ``dim``."""
    flat = tx._col(flat)
    return F.transform(F.sequence(F.lit(0), tx._col(n) - 1), lambda i: F.slice(flat, i * dim + 1, F.lit(dim)))


DEFAULT_EMBEDDER = HashedTrigramEmbedder(64)


def embed_texts(df: DataFrame, text_col: str, key_cols: Sequence[str], embedder=None,
                out_col: str = "vec") -> DataFrame:
    """One vector per row of ``df`` (keyed by ``key_cols``)."""
    return (embedder or DEFAULT_EMBEDDER).embed(df, text_col, key_cols, out_col)


def embed_distinct(df: DataFrame, text_col: str, embedder=None, out_col: str = "vec",
                   cache: DataFrame | None = None) -> DataFrame:
    """Embed each distinct text once (keyed by md5) and share the vector.

    ``cache`` is an optional table (content_key, vec) of vectors computed before; only
    keys missing from it are embedded.
    """
    keyed = df.withColumn("content_key", tx.content_key(F.col(text_col)))
    distinct = keyed.select("content_key", text_col).dropDuplicates(["content_key"])
    if cache is not None:
        distinct = distinct.join(cache.select("content_key"), "content_key", "left_anti")
    fresh = embed_texts(distinct, text_col, ["content_key"], embedder, out_col)
    if cache is not None:
        fresh = fresh.unionByName(cache.select("content_key", out_col))
    return keyed.join(fresh, "content_key", "left")


def cache_stats(vectors_by_key: DataFrame, embedder=None, out_col: str = "vec") -> DataFrame:
    """C2 report: cache size, dimension, model name."""
    emb = embedder or DEFAULT_EMBEDDER
    return vectors_by_key.agg(
        F.countDistinct("content_key").cast("long").alias("cache_size"),
        F.max(F.size(out_col)).cast("long").alias("embedding_dimension"),
    ).withColumn("model_name", F.lit(emb.name))


def consecutive_similarity(segments: DataFrame, vec_col: str = "vec", by: str = "task_id",
                           order: str = "seg_no") -> DataFrame:
    """Cosine of each segment with the previous one in its transcript (null for the first).

    Written as an equi-join on (task, seg_no - 1) rather than a window, so a transcript with
    very many segments is spread over many tasks instead of sorted in one.
    """
    prev = segments.select(F.col(by), (F.col(order) + 1).alias(order), F.col(vec_col).alias("_prev_vec"))
    j = segments.join(prev, [by, order], "left")
    sim = F.when(F.col("_prev_vec").isNull(), F.lit(None).cast("double")).otherwise(
        vx.cosine_similarity(F.col("_prev_vec"), F.col(vec_col)))
    return j.withColumn("sim_prev", sim).drop("_prev_vec")


def centroid(df: DataFrame, by: Sequence[str], vec_col: str = "vec", out_col: str = "center") -> DataFrame:
    """Element-wise mean of the vectors of each group.

    Positions are exploded and averaged with a partial aggregate, so a hot group is summed
    map-side before the shuffle; the per-group array is rebuilt from ``dim`` rows.
    """
    by = list(by)
    ex = df.select(*by, F.posexplode(vec_col).alias("_pos", "_x"))
    per_pos = ex.groupBy(*by, "_pos").agg(F.avg("_x").alias("_m"))
    return (per_pos.groupBy(*by)
            .agg(F.array_sort(F.collect_list(F.struct("_pos", "_m"))).alias("_a"))
            .select(*by, F.transform("_a", lambda s: s["_m"]).alias(out_col)))


def check_dimension(vectors: DataFrame, dim: int, vec_col: str = "vec") -> tuple[DataFrame, DataFrame]:
    """(rows with the index dimension, rows rejected)."""
    ok = F.coalesce(F.size(vec_col) == F.lit(dim), F.lit(False))
    return vectors.filter(ok), vectors.filter(~ok)
