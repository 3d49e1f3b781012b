"""Divergence of sources: how far each source's use of words lies from every other source of its language.

Words are counted per (language, source) and kept in a term-major index: per term, the sources that use it.
The squared distances between all sources of a language are a sparse matrix product, built row by row
(Gustavson): a block of the index holds all postings of its terms; each source of the block scatters its
terms through the index into one dense accumulator over its peers, so pairs of postings are never rows.
A posting that a source lacks still has a smoothed share. Those zero baselines are summed beforehand from
the number of terms per share, as if no term were common, and the accumulators carry what a common
term changes in that. All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import blocks, col, materialize, text_bytes

#: Shares are in billionths.
UNIT = 1_000_000_000
#: Distinct (source, term) pairs that a task counts before it hands them on; bytes of a long text split at once.
FLUSH, SLICE = 400_000, 4 << 20
#: Postings of a block of the index, sources whose rows one task scatters, sources of a tile's side, postings gathered at once.
BLOCK_POSTINGS, BLOCK_ROWS, TILE, GATHER = 50_000, 2_048, 128, 1 << 19

_A, _Z = ord("A"), ord("Z")
#: Lower-cases A-Z, keeps a-z and all bytes of other characters, blanks the rest.
_FOLD = bytes(b + 32 if _A <= b <= _Z else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _slices(text: bytes):
    """Folded text cut at blanks into pieces of about ``SLICE`` bytes."""
    folded, at = text.translate(_FOLD), 0
    while len(folded) - at > SLICE:
        end = folded.find(b" ", at + SLICE)
        if end < 0:
            break
        yield folded[at:end]
        at = end
    yield folded[at:] if at else folded


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, n_docs) over whole texts; null texts, languages and sources are empty strings.

    Tasks add up what they read before it is exchanged. Every row is a document, also a repeated one.
    """
    d = docs.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    schema = "lang string, source string, term string, count long, n_docs long"

    def rows(found):
        for (lang, source), (count, n_docs) in found.items():
            if count:
                n = len(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang], pa.string()).take(pa.array(np.zeros(n, np.int64))),
                     pa.array([source], pa.string()).take(pa.array(np.zeros(n, np.int64))),
                     pa.array(list(count), pa.binary()).cast(pa.string()), pa.array(list(count.values()), pa.int64()),
                     pa.array([n_docs[t] for t in count], pa.int64())],
                    names=["lang", "source", "term", "count", "n_docs"])

    def run(batches):
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch, texts in blocks(batches):
            data, off = text_bytes(texts)
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                count, n_docs = found.setdefault(key, (Counter(), Counter()))
                own = set()
                for part in _slices(data[off[i]:off[i + 1]].tobytes()):
                    words = part.split()
                    count.update(words)
                    own.update(words)
                n_docs.update(own)
            if sum(len(c) for c, _ in found.values()) > FLUSH:
                yield from rows(found)
                found = {}
        yield from rows(found)

    return (d.mapInArrow(run, schema).groupBy("lang", "source", "term")
            .agg(F.sum("count").alias("count"), F.sum("n_docs").alias("n_docs")))


def term_index(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """(lang, term, total, postings of (source, count)): the terms in at least ``min_docs`` documents of their language.

    A term's postings are as many as sources use it in that language.
    """
    return (term_counts(docs).groupBy("lang", "term")
            .agg(F.sum("n_docs").alias("n"), F.sum("count").alias("total"),
                 F.collect_list(F.struct("source", "count")).alias("postings"))
            .filter(F.col("n") >= min_docs).drop("n"))


def share(count: Column, of: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / of), exact for any count; 1 where there is nothing to share."""
    up = (count + 1).cast("decimal(27,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return (F.when(of > 0, F.floor((up - up % of.cast("decimal(20,0)")) / of.cast("decimal(20,0)"))).otherwise(0) + 1).cast("long")


def groups(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(lang, source, gid, size, lang_size, n_sources, p0) of every occurring group, also those without kept terms.

    ``size`` and ``lang_size`` are counts of the group and language plus the number of terms; ``p0`` is the share of
    an absent term; ``gid`` counts a language's sources from 0.
    """
    per_lang = index.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("in_lang"))
    own = (index.select("lang", F.explode("postings").alias("x")).groupBy("lang", F.col("x.source").alias("source"))
           .agg(F.sum("x.count").alias("own")))
    g = docs.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    g = g.join(own, ["lang", "source"], "left").join(per_lang, "lang", "left").fillna(0, ["own", "v", "in_lang"])
    by = Window.partitionBy("lang")  # one small row per source; the result itself has their square
    return g.select("lang", "source", (F.row_number().over(by.orderBy("source")) - 1).alias("gid"), "v",
                    (F.col("own") + F.col("v")).alias("size"), (F.col("in_lang") + F.col("v")).alias("lang_size"),
                    F.count(F.lit(1)).over(by).alias("n_sources")).withColumn("p0", share(F.lit(0), F.col("size")))


def postings(index: DataFrame, group: DataFrame) -> DataFrame:
    """(lang, term, total, source, gid, p, p0, size, lang_size, n_sources) of every posting."""
    flat = index.select("lang", "term", "total", F.explode("postings").alias("x")).select(
        "lang", "term", "total", F.col("x.source").alias("source"), F.col("x.count").alias("count"))
    return flat.join(group, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("size")))


def excess_terms(index: DataFrame, group: DataFrame, ranks: int = 200) -> DataFrame:
    """Terms that a group uses more than its language does: (lang, source, item, value, rank), the first ``ranks``.

    Equal values rank by term; the best of each task are found before anything is exchanged.
    """
    t = postings(index, group).withColumn("q", share(F.col("total"), F.col("lang_size"))).filter("p > q")
    t = t.select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return t.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= ranks)


def _f(p, q):
    return (p - q) * (p - q) // q


def _scatter_rows(key, table):
    """What common terms change, per (row, peer): each source of the part scatters its terms through the block's index."""
    lang, part, parts = key[0].as_py(), key[2].as_py(), table.column("parts")[0].as_py()
    term = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.argsort(term, kind="stable")
    term = term[order]
    gid, p, p0 = (table.column(c).to_numpy()[order].astype(np.int64) for c in ("gid", "p", "p0"))
    first = np.searchsorted(term, np.arange(term[-1] + 2))  # postings of term t: first[t] to first[t + 1]
    peers, peer = np.unique(gid, return_inverse=True)
    rows = np.argsort(gid, kind="stable")
    bounds = np.searchsorted(gid[rows], peers, "left").tolist() + [len(rows)]
    out = []
    for k, g in enumerate(peers.tolist()):
        if g % parts != part:
            continue
        own = rows[bounds[k]:bounds[k + 1]]
        total, seen = np.zeros(len(peers), np.int64), np.zeros(len(peers), bool)
        n = np.diff(first)[term[own]]
        cuts = np.searchsorted(np.cumsum(n), np.arange(GATHER, n.sum() + GATHER, GATHER), "right").tolist()
        a = 0
        for z in cuts:
            z = max(z, a + 1)
            mine, m = own[a:z], n[a:z]
            if not len(mine):
                continue
            at = np.arange(m.sum()) + np.repeat(first[term[mine]] - (np.cumsum(m) - m), m)
            mp, mp0, q, q0 = np.repeat(p[mine], m), p0[mine[0]], p[at], p0[at]
            np.add.at(total, peer[at], _f(mp, q) - _f(mp, q0) - _f(mp0, q) + _f(mp0, q0))
            seen[peer[at]] = True
            a = z
        seen[k] = False
        out.append((g, peers[seen], total[seen]))
    size = sum(len(h) for _, h, _ in out)
    return pa.table({"lang": pa.array([lang] * size, pa.string()),
                     "g": pa.array(np.concatenate([np.full(len(h), g) for g, h, _ in out] or [np.zeros(0)]).astype(np.int64)),
                     "h": pa.array(np.concatenate([h for _, h, _ in out] or [np.zeros(0)]).astype(np.int64)),
                     "value": pa.array(np.concatenate([v for _, _, v in out] or [np.zeros(0)]).astype(np.int64))})


def _baselines(key, left, right):
    """Sums as if no term were common, for all pairs of a tile: both sides' absent shares and terms per share."""
    side = []
    for t in (left, right):
        shares = [[(x["p"], x["n"]) for x in h or []] for h in t.column("shares").to_pylist()]
        side.append((t.column("gid").to_numpy().astype(np.int64), t.column("p0").to_numpy().astype(np.int64),
                     [np.array(s, np.int64).reshape(-1, 2) for s in shares]))
    (g, g0, gs), (h, h0, hs) = side
    v = left.column("v")[0].as_py() if left.num_rows else 0
    zero = _f(g0[:, None], h0[None, :])
    total = v * zero
    for i, s in enumerate(gs):
        for a in range(0, len(s), 4096):
            p, n = s[a:a + 4096, :1], s[a:a + 4096, 1:]
            total[i] += (n * (_f(p, h0[None, :]) - zero[i])).sum(0)
    for j, s in enumerate(hs):
        for a in range(0, len(s), 4096):
            q, n = s[a:a + 4096, :1], s[a:a + 4096, 1:]
            total[:, j] += (n * (_f(g0[None, :], q) - zero[:, j])).sum(0)
    i, j = np.nonzero(g[:, None] != h[None, :])
    return pa.table({"lang": pa.array([key[0].as_py()] * len(i), pa.string()), "g": pa.array(g[i]), "h": pa.array(h[j]),
                     "value": pa.array(total[i, j])})


def pair_divergence(index: DataFrame, group: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): each source against each other one of its language, over all kept terms.

    Blocks hold whole terms of one language, by hash; a block with very many sources is read by several
    tasks, each scattering its share of them. Equal values rank by the other source's name.
    """
    out = "lang string, g long, h long, value long"
    flat = postings(index, group)
    n_blocks = (index.groupBy("lang").agg(F.sum(F.size("postings")).alias("n"))
                .select("lang", F.ceil(F.col("n") / BLOCK_POSTINGS).alias("n_blocks")))
    rows = (flat.join(n_blocks, "lang").withColumn("parts", F.ceil(F.col("n_sources") / BLOCK_ROWS))
            .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            .select("lang", F.pmod(F.xxhash64("term"), F.col("n_blocks")).alias("block"), "part", "parts", "term", "gid", "p", "p0"))
    common = rows.groupBy("lang", "block", "part").applyInArrow(_scatter_rows, out)

    per_share = flat.groupBy("lang", "gid", "p").agg(F.count(F.lit(1)).alias("n"))
    per_group = per_share.groupBy("lang", "gid").agg(F.collect_list(F.struct("p", "n")).alias("shares"))
    sides = group.select("lang", "gid", "v", "p0", "n_sources").join(per_group, ["lang", "gid"], "left")
    own, last = F.floor(F.col("gid") / TILE), F.floor((F.col("n_sources") - 1) / TILE)
    other = F.explode(F.sequence(F.lit(0).cast("long"), last))
    sides = sides.withColumn("own", own).withColumn("other", other).drop("n_sources")
    left = sides.withColumnsRenamed({"own": "a", "other": "b"})
    names = ["b" if c == "own" else "a" if c == "other" else c for c in sides.columns]
    right = sides.select(*[F.col(c).alias(f"_{c}") for c in sides.columns]).toDF(*names)  # columns of its own for the cogroup
    base = left.groupBy("lang", "a", "b").cogroup(right.groupBy("lang", "a", "b")).applyInArrow(_baselines, out)

    v = base.unionByName(common).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    names = group.select("lang", F.col("gid").alias("g"), "source")
    v = v.join(names, ["lang", "g"]).join(names.withColumnsRenamed({"g": "h", "source": "item"}), ["lang", "h"])
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return v.select("lang", "source", "item", "value", F.row_number().over(w).alias("rank"))


def source_divergence(docs: DataFrame, min_docs: int = 3, ranks: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for all other sources, ``term`` rows for excess terms.

    Null languages, sources and texts count as empty strings; a text without terms still makes its group
    occur; an empty table gives no rows; other columns are not read. A long text is split piece by piece; its
    distinct terms are held by one task.
    """
    index = materialize(term_index(docs, min_docs), "divergence-index")
    group = materialize(groups(docs, index), "divergence-groups")
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(pair_divergence(index, group), "pair").unionByName(part(excess_terms(index, group, ranks), "term"))
