"""Order MinHash near-duplicates: sketches that keep text order, verified by banded alignment.

A text is its sequence of five-word shingles, each labelled with its occurrence number. Every
repeat of a sketch samples the ``PICK`` labelled shingles of least hash and keeps them in text
order; texts agree on a repeat only if they share those shingles in that order, so moved blocks
do not count as similar. Candidates that share a repeat are verified by the exact alignment of
their shingle sequences inside the band that the threshold allows:
similarity = aligned / (a + b - aligned) >= 0.8.

Equal texts are one node. Inside a bucket (one equal repeat, or two neighbouring ones, and
compatible lengths) nodes are not compared with each other but with one hub, round after round:
components found so far are represented by one member each, a new hub is drawn, and the rounds
end when one gives few new links or none. Parity bitmaps exclude pairs that cannot reach the threshold
before they meet their texts, and two components that meet in many buckets align their closest pair
only. So a bucket of g texts costs at most g alignments per round, and no bucket is capped. The buckets of two repeats part families that meet by a common passage.

The rounds only join families cheaply; they do not end the search. Members of buckets that still
hold several components are finished exactly (:func:`rest_pairs`): every pair of them in different
components is aligned unless a bound proves it below the threshold.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Words, blocks, col, materialize, mix, occurrence, packed, text_bytes, unpacked
from tessera.llm.components import joined_components

SHINGLE = 5
THRESHOLD = 0.8
#: A pair at 0.8 shares a repeat with probability about 0.8**3; it misses all 14 with about 1e-4.
PICK, REPEATS = 3, 14
#: The rounds end with one whose links, times this, are fewer than all links so far; what is left is finished exactly.
FEW = 50
#: Longs in a text's parity bitmap.
PARITY = 8
BITS = tuple(f"b{k}" for k in range(PARITY))
_SEEDS = mix(np.arange(1, REPEATS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = mix(_SEEDS) | np.uint64(1)
_FOLD = np.uint64(0xD6E8FEB86659FD93)


def labelled(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit occurrence-labelled shingles, offsets of the texts); a text of 1 to 4 words has one shingle."""
    sh, first = Words(data, off).shingles(SHINGLE)
    return mix(sh + occurrence(sh, first).astype(np.uint64) * _FOLD), first


def order_sketch(values: np.ndarray) -> np.ndarray:
    """One signature per repeat: the least ``PICK`` values under that repeat's hash, in text order."""
    k = min(PICK, len(values))
    out = np.empty(REPEATS, np.uint64)
    rows = max(1, min(REPEATS, (1 << 21) // max(1, len(values))))  # long texts: fewer repeats at once
    for r in range(0, REPEATS, rows):
        h = (values[None, :] ^ _SEEDS[r:r + rows, None]) * _ODD[r:r + rows, None]
        at = np.argpartition(h ^ (h >> np.uint64(31)), k - 1, axis=1)[:, :k]
        at.sort(axis=1)
        s = np.zeros(len(at), np.uint64)
        for j in range(k):
            s = s * _FOLD + values[at[:, j]]
        out[r:r + rows] = mix(s + _SEEDS[r:r + rows] + np.uint64(k))
    return out


def _text_keys(text: str) -> list:
    t = F.coalesce(col(text), F.lit(""))
    return [F.xxhash64(t).alias("t1"), F.xxhash64(F.lit("second"), t).alias("t2")]


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(t1, t2, id, n, sigs) of every row; a text without words has no signatures."""

    def run(batches):
        for batch, texts in blocks(batches):
            values, first = labelled(*text_bytes(texts))
            n = np.diff(first)
            sigs = [order_sketch(values[a:z]) for a, z in zip(first[:-1], first[1:]) if z > a]
            flat = (np.concatenate(sigs) if sigs else np.zeros(0, np.uint64)).view(np.int64)
            off = np.concatenate([[0], np.cumsum((n > 0) * REPEATS)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(off, flat)],
                names=["t1", "t2", "id", "n", "sigs"])

    return (docs.select(*_text_keys(text_col), col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
            .mapInArrow(run, "t1 long, t2 long, id long, n long, sigs array<long>"))


def parities(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``PARITY`` longs per text: per bit, whether an odd number of the text's shingles fall on it.

    Two texts differ in at most as many bits as there are shingles that only one of them has.
    """
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    bit = (mix(values) >> np.uint64(55)).astype(np.int64)
    odd = np.bincount(owner * 64 * PARITY + bit, minlength=n * 64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(n, PARITY)


def sequences(texts: DataFrame) -> DataFrame:
    """(node, seq, b0, b1, ...) from (node, text): the labelled shingles in text order and their parities."""

    def run(batches):
        for batch, t in blocks(batches):
            values, first = labelled(*text_bytes(t))
            longs = parities(values, first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(first.astype(np.int32), values.view(np.int64)),
                 *(pa.array(longs[:, k].copy()) for k in range(PARITY))], names=["node", "seq", *BITS])

    schema = ", ".join(["node long", "seq array<long>", *(f"{b} long" for b in BITS)])
    return texts.select("node", "text").mapInArrow(run, schema)


def alignment(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """aligned / (len(a) + len(b) - aligned) for the longest common order inside the band; 0.0 if below ``threshold``.

    Labelled shingles are distinct inside a text, so the alignment is the longest increasing run of
    matched positions. A pair that reaches the threshold leaves at most ``both * (1 - t) / (1 + t)``
    shingles unaligned; no matched pair can be further apart than that (the band).
    """
    both = len(a) + len(b)
    if not both:
        return 1.0
    least = threshold * both / (1 + threshold) - 1e-9
    if min(len(a), len(b)) < least:
        return 0.0
    order = np.argsort(a)
    s = a[order]
    at = np.minimum(np.searchsorted(s, b), len(s) - 1)
    hit = s[at] == b
    i, j = order[at[hit]], np.flatnonzero(hit)
    near = np.abs(i - j) <= both - 2 * least + 1
    i = i[near]
    if len(i) < least:
        return 0.0
    if np.all(i[1:] > i[:-1]):
        m = len(i)
    else:
        tails: list[int] = []
        for x in i.tolist():
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        m = len(tails)
    sim = m / (both - m)
    return sim if m >= least else 0.0


def verified(pairs: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose alignment reaches the threshold."""
    left = seqs.select(F.col("node").alias("a"), F.col("seq").alias("x"))
    right = seqs.select(F.col("node").alias("b"), F.col("seq").alias("y"))

    def run(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            xv, xo = x.values.to_numpy(), x.offsets.to_numpy()
            yv, yo = y.values.to_numpy(), y.offsets.to_numpy()
            ok = [alignment(xv[xo[r]:xo[r + 1]], yv[yo[r]:yo[r + 1]], threshold) > 0 for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def cells(nodes: DataFrame, threshold: float) -> DataFrame:
    """(key, node, n): every signature, and every two neighbouring ones, once for the text's length class
    and once for the next.

    Lengths of a similar pair differ by at most the threshold's factor, so their classes are equal
    or neighbours and the pair shares a cell.
    """
    step = float(np.log(1 / threshold))
    size = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int")
    last = F.element_at("sigs", -1)
    two = F.zip_with("sigs", F.concat(F.array(last), F.slice("sigs", 1, REPEATS - 1)), lambda x, y: F.xxhash64(x, y))
    e = nodes.filter("n > 0").select("node", "n", size.alias("size"), F.posexplode(F.concat("sigs", two)).alias("repeat", "sig"))
    e = e.withColumn("size", F.explode(F.array("size", F.col("size") + 1)))
    return e.select(F.xxhash64("repeat", "sig", "size").alias("key"), "node", "n")


def round_pairs(members: DataFrame, labels: DataFrame | None, turn: int, threshold: float) -> DataFrame:
    """Pairs (a, b) that may be verified in this round: per bucket one member of every component against the hub.
    x, y are their components, apart the parities in which they differ.

    First round: every node against the bucket's least node. Later: one member of each component
    against one of the bucket's largest component, both drawn anew per bucket, so a text meets as
    many members of a family as it shares buckets with it. Pairs whose parities prove them below the
    threshold are left out, so a bucket of a common passage costs no alignments.
    """
    m = members.withColumn("comp", F.col("node")) if labels is None else (
        members.join(labels, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root"))
    draw = F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("h"), "node", "n", *BITS)
    per = m.groupBy("key", "comp").agg(F.min(draw).alias("one"), F.count(F.lit(1)).alias("size"))
    order = F.col("comp") if turn == 1 else F.struct(-F.col("size"), F.xxhash64("comp", "key", F.lit(turn)))
    hub = per.groupBy("key").agg(F.min(F.struct(order.alias("h"), "comp", "one")).alias("hub"), F.count(F.lit(1)).alias("c"))
    p = per.join(hub.filter("c > 1").select("key", "hub"), "key").filter("comp <> hub.comp")
    p = (p.select(F.col("comp").alias("x"), F.col("hub.comp").alias("y"), F.col("one").alias("u"), F.col("hub.one").alias("v"))
         .filter(near("u", "v", threshold)))
    return p.select(F.least("u.node", "v.node").alias("a"), F.greatest("u.node", "v.node").alias("b"),
                    F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), apart("u", "v").alias("apart"))


def apart(u: str, v: str):
    """Number of parities in which structs ``u`` and ``v`` differ."""
    return sum((F.bit_count(F.col(u).getField(b).bitwiseXOR(F.col(v).getField(b))) for b in BITS), F.lit(0))


def near(u: str, v: str, threshold: float):
    """Whether the lengths and parities of structs ``u`` and ``v`` (n, b0, ...) allow the threshold."""
    n, o = F.col(u).getField("n"), F.col(v).getField("n")
    least = F.lit(threshold / (1 + threshold)) * (n + o) - F.lit(1e-6)
    return (F.least(n, o) >= least) & (apart(u, v) <= n + o - 2 * least)


def rest_pairs(members: DataFrame, labels: DataFrame | None, seqs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different components among the members of all buckets that hold several components,
    without those that cannot reach the threshold.

    The bounds are exact. The shingles of all these texts get one order, rarest first. A similar pair
    has at least ``t / (1 + t) * (a + b)`` shingles in common, so the first one it has in common stands
    in both texts early enough to leave as many, itself included; pairs meet by such shingles only. A text's
    own share of a crowd's passage stands last, so a crowd does not meet by its passage. What meets must
    also differ in no more parity bits than a similar pair has shingles apart.
    """
    comp = F.col("node") if labels is None else F.coalesce("root", "node")
    m = members if labels is None else members.join(labels, "node", "left")
    m = m.select("key", "node", "n", comp.alias("comp"))
    open_ = m.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("key")
    left = materialize(m.join(open_, "key").groupBy("node").agg(F.first("n").alias("n"), F.first("comp").alias("comp")), "rest")
    own = seqs.join(left.select("node"), "node")
    tokens = own.select("node", F.explode("seq").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranked = (tokens.join(common, "token").groupBy("node")
              .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("common")))
    # Shingles of one text only come first; the last place that leaves threshold * n shingles is n - threshold * n.
    room = F.floor(F.col("n") * F.lit(1 - threshold) + F.lit(1e-6)).cast("int") + 1
    ranked = ranked.join(left, "node").withColumn("before", (F.col("n") - F.size("common")).cast("int"))
    early = ranked.withColumn("early", F.slice("common", F.lit(1), F.greatest(room - F.col("before"), F.lit(0))))
    early = (early.filter(F.size("early") > 0)
             .select("node", "n", "comp", "before", F.posexplode("early").alias("at", "s"))
             .select("node", "n", "comp", F.col("s.token").alias("token"),
                     (F.col("n") - F.col("before") - F.col("at")).alias("after")))
    early = materialize(early, "early")
    per = early.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("size"))
    most = (per.groupBy("token").agg(F.max(F.struct("size", "comp")).alias("most"), F.count(F.lit(1)).alias("c"))
            .filter("c > 1").select("token", F.col("most.comp").alias("main")))
    own_bits = own.select("node", *BITS)
    met = early.join(most, "token").join(own_bits, "node")
    met = materialize(met.withColumn("s", F.struct("n", *BITS)).drop("n", *BITS), "met")
    x = met.filter("comp <> main").select("token", *[F.col(c).alias(f"x_{c}") for c in ("node", "comp", "after", "s")])
    least = F.lit(threshold / (1 + threshold)) * (F.col("x_s.n") + F.col("s.n")) - F.lit(1e-6)
    # Pairs with the shingle's largest component come from the other side only; the rest once by node.
    pairs = x.hint("merge").join(met, "token").filter(
        (F.col("comp") != F.col("x_comp")) & ((F.col("comp") == F.col("main")) | (F.col("x_node") < F.col("node")))
        & (F.least("after", "x_after") >= least) & near("x_s", "s", threshold))
    return pairs.select(F.least("x_node", "node").alias("a"), F.greatest("x_node", "node").alias("b")).distinct()


def _nodes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): the sketched rows without signatures, and one node per distinct text."""
    sk = materialize(sketches(docs, id_col, text_col), "sketches")
    distinct = sk.groupBy("t1", "t2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sigs").alias("sigs"))
    nodes = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    return sk.select("t1", "t2", "id"), nodes


def links(docs: DataFrame, nodes: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame | None:
    """(node, root) of all nodes linked to another text; None if there are none."""
    c = cells(nodes, threshold)
    shared = c.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    members = materialize(c.join(shared, "key"), "buckets")
    needed = members.select("node").distinct().join(
        nodes.select("node", F.col("t1").alias("n1"), F.col("t2").alias("n2"), F.col("id").alias("nid")), "node")
    d = docs.select(*_text_keys(text_col), col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    texts = d.join(needed, (F.col("t1") == F.col("n1")) & (F.col("t2") == F.col("n2"))
                   & F.col("id").eqNullSafe(F.col("nid"))).select("node", "text")
    # Repeated rows of a text give the same sequence; one is enough.
    seqs = materialize(sequences(texts.groupBy("node").agg(F.first("text").alias("text"))), "sequences")
    members = materialize(members.join(seqs.select("node", *BITS), "node"), "members")
    tested, labels, turn, found = None, None, 0, 0
    while True:  # The last round ends only the cheap joining; what is untested then is left to the rest.
        turn += 1
        pairs = round_pairs(members, labels, turn, threshold)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        # Two components need one link: their closest pair is aligned now, another in a later round.
        closest = pairs.groupBy("x", "y").agg(F.min(F.struct("apart", "a", "b")).alias("p"))
        pairs = materialize(closest.select("p.a", "p.b"), "pairs")
        if pairs.isEmpty():
            break
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = materialize(verified(pairs, seqs, threshold), "verified")
        n = new.count()
        if not n:
            break
        labels = joined_components(labels, new)
        found += n
        if n * FEW < found:
            break
    rest = rest_pairs(members, labels, seqs, threshold)
    if tested is not None:
        rest = rest.join(tested, ["a", "b"], "left_anti")
    new = materialize(verified(materialize(rest, "rest-pairs"), seqs, threshold), "verified")
    return labels if new.isEmpty() else joined_components(labels, new)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (t1, t2, id) as given; classes (t1, t2, id, root, class_id) of every distinct text.

    class_id is the smallest id of all rows of the class (null if none has an id).
    """
    rows, nodes = _nodes(docs, id_col, text_col)
    roots = links(docs, nodes, id_col, text_col, threshold)
    n = nodes.select("node", "t1", "t2", "id")
    n = n.withColumn("root", F.col("node")) if roots is None else (
        n.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    ids = n.groupBy("root").agg(F.min("id").alias("class_id"))
    return rows, materialize(n.join(ids, "root"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, class_size, kept), one row per input row: classes of texts linked at the threshold.

    Equal texts share a class, null and empty texts too (they count as one empty text); a text
    without words links to no other text. Rows without an id join a class like any other. kept:
    the row's id is the class id (all repeated rows of it). An empty table gives no rows; other
    columns are not read.
    """
    rows, classes = classify(docs, id_col, text_col, threshold)
    r = rows.join(classes.select("t1", "t2", "root", "class_id"), ["t1", "t2"])
    size = r.groupBy("root").agg(F.count(F.lit(1)).alias("class_size"))
    return r.join(size, "root").select(F.col("id").alias("doc_id"), "class_id", "class_size",
                                       F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: of every class one row, that of the smallest id (rows without an id last)."""
    _, classes = classify(docs, id_col, text_col, threshold)
    best = classes.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")).alias("s"))
    best = best.select(F.col("s.t1").alias("b1"), F.col("s.t2").alias("b2"), F.col("s.id").alias("b"))
    d = packed(docs, *_text_keys(text_col), col(id_col).cast("long").alias("id"))
    d = d.join(best, (F.col("t1") == F.col("b1")) & (F.col("t2") == F.col("b2")) & F.col("id").eqNullSafe(F.col("b")))
    one = Window.partitionBy("t1", "t2").orderBy(F.xxhash64("doc"))  # repeated rows of one id and text
    return unpacked(d.withColumn("at", F.row_number().over(one)).filter("at = 1"), docs.columns)
