"""Language identification by Bayesian evidence fusion.

Evidence for each row: the likelihood of its text under byte-trigram models, the declared
(markup) language, the address suffix and the host. A text-only pass over all rows gives
posteriors; grouped aggregation turns them into a table of how each language is declared and
into priors smoothed down the hierarchy all rows -> suffix -> host (a row's own mass is taken out of
its host's, so no row is evidence for itself). The fused posterior decides.

The class ``und`` explains text that no language model explains better than chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import blocks, col, materialize, packed, text_bytes, unpacked

LANGUAGES = ("en", "fr", "de", "es")
UNKNOWN = "und"
#: Trigram buckets, and the expected number of training rows per language (the bounded sample).
BUCKET_BITS, SAMPLE_ROWS = 15, 3000
#: A training text weighs at most so many trigrams; smoothing of a bucket, in trigrams.
TRAIN_WEIGHT, SMOOTHING = 4000, 0.05
#: A text counts as at most so many independent trigrams, so that length does not drown other evidence.
EVIDENCE = 60.0
#: Strength, in rows, of the parent's distribution in a child's prior.
KAPPA = 20.0
_SCALE = 1_000_000

_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every byte trigram with a letter: A-Z lowered, other ASCII a blank, the rest as it is."""
    data, off = text_bytes(texts)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = _FOLD[data].astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    ok = (b[:-2] != 32) | (b[1:-1] != 32) | (b[2:] != 32)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    ok &= doc[:-2] == doc[2:]
    return (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)[ok], doc[:-2][ok]


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", languages=LANGUAGES,
          sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Log-probabilities (bucket, language + und) from a sample of labelled texts, spread by hash over all of them.

    The sample has ``sample_rows`` distinct texts per language at most, each once however often it is
    repeated: those with the smallest hashes. Counting is distributed and at most languages x 2**15 sums reach
    the driver. Null texts are left out; a language without texts gets a flat model.
    """
    label, text = col(label_col).cast("string"), col(text_col)
    d = docs.select(label.alias("label"), text.alias("text")).filter(F.col("label").isin(list(languages)) & F.col("text").isNotNull())
    d = d.withColumn("h", F.xxhash64("text"))
    first = Window.partitionBy("label").orderBy("h")
    drawn = (d.select("label", "h").distinct().withColumn("r", F.row_number().over(first)).filter(F.col("r") <= sample_rows)
             .select(F.col("label").alias("_label"), F.col("h").alias("_h")))
    # At most languages x sample_rows keys; each task hands on a drawn text once.
    d = (d.join(F.broadcast(drawn), (F.col("label") == F.col("_label")) & (F.col("h") == F.col("_h")), "left_semi")
         .dropDuplicates(["label", "h"]).select("label", "text"))
    index = {lang: i for i, lang in enumerate(languages)}

    def count(batches):
        table = np.zeros((len(languages), 1 << BUCKET_BITS), np.int64)
        for batch, texts in blocks(batches):
            at = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
            bucket, doc = trigrams(texts)
            n = np.maximum(np.bincount(doc, minlength=len(texts)), 1)
            weight = np.maximum(1000 * TRAIN_WEIGHT // np.maximum(n, TRAIN_WEIGHT), 1)  # thousandths: sums stay exact
            table += np.bincount(at[doc] << BUCKET_BITS | bucket, weights=weight[doc],
                                 minlength=table.size).astype(np.int64).reshape(table.shape)
        i = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(table.ravel()[i])], names=["cell", "n"])

    rows = d.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    table = np.full((len(languages), 1 << BUCKET_BITS), SMOOTHING)
    for r in rows:
        table.ravel()[r["cell"]] += r["n"] / 1000
    probs = np.log(table / table.sum(axis=1, keepdims=True))
    flat = np.full((1, 1 << BUCKET_BITS), -BUCKET_BITS * np.log(2.0))
    return np.concatenate([probs, flat]).T.astype(np.float32).copy()


def likelihoods(model: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Log-likelihood (text, class), each text weighing at most ``EVIDENCE`` trigrams; zeros without letters."""
    bucket, doc = trigrams(texts)
    n = np.bincount(doc, minlength=len(texts)).astype(float)
    sums = np.stack([np.bincount(doc, weights=model[bucket, k], minlength=len(texts)) for k in range(model.shape[1])], 1)
    return sums * (np.minimum(n, EVIDENCE) / np.maximum(n, 1.0))[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _lists(x: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel(), kind))


def text_evidence(docs: DataFrame, model: np.ndarray, id_col: str, text_col: str, declared_col: str | None,
                  host_col: str | None, suffix_col: str | None) -> DataFrame:
    """(id, t, declared, host, suffix, ll, mass): log-likelihoods, and the text-only posterior in millionths."""
    model_b = docs.sparkSession.sparkContext.broadcast(model)  # 2**15 x classes floats, whatever the data

    def run(batches):
        for batch, texts in blocks(batches):
            ll = likelihoods(model_b.value, texts)
            mass = np.rint(_softmax(ll) * _SCALE).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], _lists(ll, pa.float64()), _lists(mass, pa.int64())],
                                             names=["id", "t", "declared", "host", "suffix", "ll", "mass"])

    return (docs.select(*_keys(id_col, text_col, declared_col, host_col, suffix_col), col(text_col).alias("text"))
            .mapInArrow(run, "id long, t long, declared string, host string, suffix string, ll array<double>, mass array<long>"))


def _keys(id_col, text_col, declared_col, host_col, suffix_col) -> list:
    """Columns that determine a row's decision."""
    s = lambda c: (col(c) if c else F.lit(None)).cast("string")
    return [col(id_col).cast("long").alias("id"), F.xxhash64(col(text_col)).alias("t"), s(declared_col).alias("declared"),
            s(host_col).alias("host"), s(suffix_col).alias("suffix")]


def _sums(classes: int, name: str) -> list:
    return [F.array(*[F.sum(F.col("mass")[k]) for k in range(classes)]).alias(name)]


def decide(docs: DataFrame, model: np.ndarray, languages=LANGUAGES, id_col: str = "doc_id", text_col: str = "text",
           declared_col: str | None = "lang", host_col: str | None = "source", suffix_col: str | None = None,
           least: float = 0.5) -> DataFrame:
    """(id, t, declared, host, suffix, language, probability, text_language, accepted), one row per input row.

    accepted: a known language is the likeliest, with probability ``least`` at least. Null
    evidence says nothing (a null declaration has factor 1; null hosts and suffixes are one group
    each). A text without a letter is judged by the other evidence and never accepted. Repeated
    rows are judged alike; an empty table gives no rows; other columns are not read.
    """
    classes = [*languages, UNKNOWN]
    k = len(classes)
    e = materialize(text_evidence(docs, model, id_col, text_col, declared_col, host_col, suffix_col), "text-evidence")
    everything = e.agg(*_sums(k, "m")).first()["m"]
    total = np.array([x or 0 for x in everything], float) + _SCALE
    root = total / total.sum()
    kinds = e.agg(F.countDistinct("declared")).first()[0]
    declared = e.filter("declared is not null").groupBy("declared").agg(*_sums(k, "declared_mass"))
    suffixes = e.groupBy("suffix").agg(*_sums(k, "suffix_mass"))
    hosts = e.groupBy("host", "suffix").agg(*_sums(k, "host_mass"))
    r = e
    for table, on in ((declared, ["declared"]), (suffixes, ["suffix"]), (hosts, ["host", "suffix"])):
        named = table.select(*[F.col(c).alias(f"_{c}") for c in on], table.columns[-1])
        cond = F.lit(True)
        for c in on:
            cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
        r = r.join(named, cond, "left").drop(*[f"_{c}" for c in on])
    spread = float(max(kinds, 1))
    names = np.array(classes)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            get = lambda c: np.array(b.column(b.schema.get_field_index(c)).to_pylist(), float).reshape(-1, k)
            ll, own = get("ll"), get("mass")
            said = b.column(b.schema.get_field_index("declared")).is_valid().to_numpy(zero_copy_only=False)
            d = b.column(b.schema.get_field_index("declared_mass")).to_pylist()
            d = np.array([x if x is not None else [0.0] * k for x in d], float).reshape(-1, k)
            # How often each language is declared this way, without the row itself; add-one smoothed.
            tell = (np.maximum(d - own, 0) / _SCALE + 1.0) / (total[None, :] / _SCALE + spread)
            suffix = get("suffix_mass") / _SCALE
            up = (suffix + KAPPA * root) / (suffix.sum(axis=1, keepdims=True) + KAPPA)
            host = np.maximum(get("host_mass") - own, 0) / _SCALE
            prior = (host + KAPPA * up) / (host.sum(axis=1, keepdims=True) + KAPPA)
            post = _softmax(ll + np.log(prior) + np.where(said[:, None], np.log(tell), 0.0))
            best, silent = post.argmax(axis=1), np.all(ll == 0, axis=1)
            p = np.round(post.max(axis=1), 9)
            ok = (best < k - 1) & (p >= least) & ~silent
            text = np.where(silent, UNKNOWN, names[ll.argmax(axis=1)])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(names[best]), pa.array(p), pa.array(text), pa.array(ok)],
                                             names=["id", "t", "declared", "host", "suffix", "language", "probability",
                                                    "text_language", "accepted"])

    return r.mapInArrow(run, "id long, t long, declared string, host string, suffix string, language string, "
                             "probability double, text_language string, accepted boolean")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang",
             host_col: str | None = "source", suffix_col: str | None = None, languages=LANGUAGES,
             model: np.ndarray | None = None, **options) -> DataFrame:
    """(id_col, declared, language, probability, text_language, accepted); trains on the declared rows if no model is given."""
    if model is None:
        model = train(docs, text_col, declared_col, languages)
    r = decide(docs, model, languages, id_col, text_col, declared_col, host_col, suffix_col, **options)
    return r.select(F.col("id").alias(id_col), "declared", "language", "probability", "text_language", "accepted")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang",
             host_col: str | None = "source", suffix_col: str | None = None, languages=LANGUAGES) -> DataFrame:
    """The rows of ``docs`` whose language is accepted."""
    model = train(docs, text_col, declared_col, languages)
    r = decide(docs, model, languages, id_col, text_col, declared_col, host_col, suffix_col)
    keys = ["id", "t", "declared", "host", "suffix"]
    out = r.filter("not accepted").select(*[F.col(c).alias(f"no_{c}") for c in keys]).distinct()
    d = packed(docs, *_keys(id_col, text_col, declared_col, host_col, suffix_col))
    cond = F.lit(True)
    for c in keys:
        cond = cond & F.col(c).eqNullSafe(F.col(f"no_{c}"))
    return unpacked(d.join(materialize(out, "rejected"), cond, "left_anti"), docs.columns)


def page_fields(pages: DataFrame) -> DataFrame:
    """Raw pages as rows for :func:`identify`: declared language of the html tag, host, suffix and visible text."""
    html, url = col("html"), col("url")
    declared = F.lower(F.nullif(F.regexp_extract(html, r"(?i)<html[^>]*\blang=[\"']?([a-z]+)", 1), F.lit("")))
    host = F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;", " ")
    return pages.select(col("page_id"), bare.alias("text"), declared.alias("lang"), host.alias("host"),
                        F.element_at(F.split(host, r"\."), -1).alias("suffix"))
