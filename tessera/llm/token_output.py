"""Token ids as Parquet: one list column per document, in ascending id order, read selectively.

Texts are range-partitioned and sorted by id, encoded in Arrow batches, and written with
controlled row groups and pages, dictionary-encoded token ids, delta-encoded integers (writer
version 2) and page indexes. Metadata reads (ids, counts, positions) never touch the token
column, and a filter on the id reaches the page indexes.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import blocks, col, materialize
from tessera.session import scratch_dir

END_ID = 2
#: Words a Python worker keeps encoded; beyond it the cache starts again, which costs time only.
CACHE_WORDS = 600_000
#: Row groups of 32 MB, pages of 256 KB; token ids (16 bits) keep their dictionary.
LAYOUT = {"parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10),
          "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true",
          "parquet.dictionary.page.size": str(1 << 20), "compression": "zstd"}
_ROWS = "doc_id long, n_tokens long, ids array<int>"

# A blank followed by one of these begins a pre-token of its own, whatever precedes it.
_CUT = re.compile(r" (?=[!-~À-ÿ])")
_NO_CUT = re.compile(r" (?![!-~À-ÿ])")
# Letters, then marks: two pre-tokens (no digits, no apostrophe, no other script).
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class WordEncoder:
    """``Tokenizer.encode`` of whole texts, with each distinct word encoded once per worker.

    Cutting a text before a blank that is followed by a printable character never cuts a
    pre-token, so the ids of a text are the ids of its words in order. Plain words go straight to
    the tokenizer's model; all others through ``encode``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.later: dict[str, bytes] = {}  # words after a blank
        self.first: dict[str, bytes] = {}  # letters at the start of a line
        self.signs: dict[str, bytes] = {}  # marks after letters
        self.line_break = array("I", self.tokenizer.encode("\n", add_special_tokens=False).ids).tobytes()
        self.map = str.maketrans({b: chr(c) for b, c in self._byte_chars().items()})

    @staticmethod
    def _byte_chars() -> dict[int, int]:
        """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from 256 on."""
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        return {**{b: b for b in keep}, **{b: 256 + i for i, b in enumerate(rest)}}

    def _model(self, part: str, blank: bool = False) -> bytes:
        """Ids of one pre-token; in the byte alphabet printable ASCII stands for itself and a blank is ``Ġ``."""
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.map)
        part = "Ġ" + part if blank else part
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def _line(self, text: str, blank: bool) -> bytes | None:
        """Ids of letters and marks, None for any other text."""
        m = _PLAIN.fullmatch(text)
        if m is None:
            return None
        letters, signs = m.groups()
        if blank:
            got = self.later.get(letters)
            if got is None:
                got = self.later[letters] = self._model(letters, True)
        else:
            got = self.first.get(letters)
            if got is None:
                got = self.first[letters] = self._model(letters)
        if not signs:
            return got
        tail = self.signs.get(signs)
        if tail is None:
            tail = self.signs[signs] = self._model(signs)
        return got + tail

    def word(self, text: str, blank: bool) -> bytes:
        # A line break between letters or marks is a pre-token of its own.
        head, *rest = text.split("\n")
        parts = [self._line(head, blank), *[self._line(x, False) for x in rest]]
        if None in parts:
            return array("I", self.tokenizer.encode(" " + text if blank else text, add_special_tokens=False).ids).tobytes()
        return self.line_break.join(parts)

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        words = _CUT.split(text) if _NO_CUT.search(text) else text.split(" ")
        head, known = words.pop(0), self.later
        parts = list(map(known.get, words))
        if None in parts:
            if len(known) > CACHE_WORDS:
                known.clear()
                self.first.clear()
                self.signs.clear()
            for i, p in enumerate(parts):
                if p is None:
                    w = words[i]
                    p = known.get(w)
                    parts[i] = p if p is not None else known.setdefault(w, self.word(w, True))
        return (self.word(head, False) if head else b"") + b"".join(parts)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per worker; it outlives the task, and with it its words."""
    return WordEncoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                     end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids) of every text, ids ending in ``end_id``; a null or empty text has only that."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch, texts in blocks(batches):
            got = [enc(t) + end for t in texts.to_pylist()]
            n = np.array([len(g) for g in got], np.int64) // 4
            flat = np.frombuffer(b"".join(got), "<u4").astype(np.int32)
            off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.ListArray.from_arrays(off, flat)],
                                             names=["doc_id", "n_tokens", "ids"])

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, _ROWS)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", end_id: int = END_ID, layout: dict[str, str] | None = None) -> str:
    """Write (doc_id, pos, n_tokens, ids) in ascending id order (null ids first, repeated ids by text).

    ``pos`` grows with the place in the files. Repeated rows are written each; an empty table
    gives a readable table without rows. Other columns are not read.
    """
    d = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    d = d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    out = encode_documents(d, tokenizer, end_id=end_id)
    (out.select("doc_id", F.monotonically_increasing_id().alias("pos"), "n_tokens", "ids")
     .write.options(**{**LAYOUT, **(layout or {})}).parquet(path))
    return path


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The written rows, or those with ``low <= doc_id <= high`` (pushed down to row groups and pages)."""
    t = spark.read.schema("doc_id long, pos long, n_tokens long, ids array<int>").parquet(path)
    if low is not None:
        t = t.filter(F.col("doc_id") >= low)
    return t if high is None else t.filter(F.col("doc_id") <= high)


def starts(meta: DataFrame) -> DataFrame:
    """``meta`` (pos, n_tokens, ...) with start: ids of all documents before it, summed per file, then over files."""
    m = meta.withColumn("file", F.shiftright("pos", 33))
    per = m.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per written file
    per = per.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (m.withColumn("upto", F.sum("n_tokens").over(inside)).join(per, "file")
            .withColumn("start", F.col("shift") + F.col("upto") - F.col("n_tokens")).drop("file", "shift", "upto"))


def checksums(tokens: DataFrame) -> DataFrame:
    """(pos, doc_id, n_tokens, ids_crc32) from the token column itself."""

    def run(batches):
        for b in batches:
            ids = b.column(2)
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            off = ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:z].tobytes()) for a, z in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(off).astype(np.int64)),
                                              pa.array(crc, pa.int64())],
                                             names=["pos", "doc_id", "n_tokens", "ids_crc32"])

    return tokens.select("pos", "doc_id", "ids").mapInArrow(run, "pos long, doc_id long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer: str | None = None, **options) -> DataFrame:
    """Write the token table to the shared scratch folder, read it back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    path = write_tokens(docs, scratch_dir(spark, "tokens"), tokenizer, **options)
    sums = materialize(checksums(read_tokens(spark, path)), "token-sums")  # the token column is read once
    return starts(sums).select("doc_id", "start", "n_tokens", "ids_crc32")
