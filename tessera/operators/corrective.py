"""Corrective retrieval.

Grading and rewriting are model calls in the original; here they are table boundaries:
:func:`grading_prompts` / :func:`rewrite_prompts` emit prompt rows, :func:`parse_grades` /
:func:`parse_rewrites` read completion rows. :func:`lexical_grades` and
:func:`keyword_rewrites` are deterministic offline stand-ins of our own (not behaviour of the
original) so that the loop can run end to end without a model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions import text as tx
from tessera.session import checkpoint

# Prompt texts of the grader and the rewriter.
GRADER_HEAD = (
    "You are a strict relevance grader. For each knowledge strip, output a JSON array where each item has: "
    "{chunk_id: string, grade: number between 0 and 1, reason: short string}.\n"
    "Grade measures how well the strip helps answer the query.\n\n"
)
GRADER_TAIL = "\nReturn ONLY valid JSON (array)."
REWRITE_HEAD = "Rewrite the following user query into {n} alternative concise searches that might retrieve better evidence.\n"
REWRITE_BODY = "Return ONLY a JSON array of strings.\n\n"

# Stop words dropped by the offline rewriter (our own stand-in).
STOP_WORDS = (
    "a an and are as at be by de des du en et for from how in is it la le les of on or que qui the to un une "
    "was what when where which who why with"
).split()

WORD_SPLIT = r"[^\p{L}\p{N}]+"


def words_of(c) -> Column:
    """The words of a text: runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(tx._col(c)), WORD_SPLIT), lambda w: w != "")


def grading_prompts(queries: DataFrame, graded: DataFrame, max_items: int = Settings().grade_max_items,
                    text_chars: int = 600, query_col: str = "query") -> DataFrame:
    """G1: one prompt per query with its first ``max_items`` strips as ``- [id] text[:600]``.

    The strips of one query are at most ``max_items`` after the filter, so the ordered collect
    is bounded.
    """
    first = graded.filter(F.col("ord") <= max_items)
    items = (first.groupBy("query_id")
             .agg(F.array_sort(F.collect_list(F.struct("ord", "chunk_id", "content"))).alias("_s")))
    lines = F.array_join(F.transform("_s", lambda s: F.concat(
        F.lit("- ["), F.coalesce(s["chunk_id"], F.lit("")), F.lit("] "),
        F.substring(F.coalesce(s["content"], F.lit("")), 1, text_chars), F.lit("\n"))), "")
    j = queries.select("query_id", query_col).join(items, "query_id", "inner")
    prompt = F.concat(F.lit(GRADER_HEAD), F.lit("Query: "), F.col(query_col), F.lit("\n\nKnowledge strips:\n"),
                      lines, F.lit(GRADER_TAIL))
    return j.select(F.col("query_id").alias("request_id"), prompt.alias("prompt"))


def whole_json(c: Column) -> Column:
    """The text as one JSON value (null if invalid, or if anything follows the value).

    The parser stops after a first value, so the text is parsed inside an array and inside an
    object: text that leaves one of them early, or adds to it, fails in one of the two.
    """
    inside = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>")
    keyed = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    return F.when((F.size(inside) == 1) & keyed.isNotNull(), F.try_parse_json(c))


def _json_array(text) -> Column:
    """The JSON array inside fenced or chatty text: first '[' to last ']' (null if none / invalid)."""
    arr = F.regexp_extract(tx._col(text), r"(?s)\[.*\]", 0)
    return whole_json(F.nullif(arr, F.lit("")))


def parse_grades(completions: DataFrame, key: str = "request_id", text_col: str = "text") -> DataFrame:
    """(request_id, elem, chunk_id, grade in [0, 1], reason) from grader completions.

    Non-object elements are skipped; a grade that is not a number (or missing) counts 0;
    text without a parsable array gives no rows.
    """
    v = completions.select(key, _json_array(text_col).alias("_v"))
    elems = v.select(key, F.posexplode(F.try_variant_get("_v", "$", "array<variant>")).alias("elem", "_e"))
    objs = elems.filter(F.schema_of_variant("_e").startswith("OBJECT"))
    grade = F.coalesce(F.try_variant_get("_e", "$.grade", "double"), F.lit(0.0))
    return objs.select(
        key, F.col("elem").cast("long").alias("elem"),
        F.coalesce(F.try_variant_get("_e", "$.chunk_id", "string"), F.lit("")).alias("chunk_id"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), grade)).alias("grade"),
        F.coalesce(F.try_variant_get("_e", "$.reason", "string"), F.lit("")).alias("reason"))


def align_grades(graded: DataFrame, grades: DataFrame, max_items: int = Settings().grade_max_items) -> DataFrame:
    """Grades joined to strips in strip order; a repeated chunk id takes its last grade;
    strips without a grade, or beyond ``max_items``, get 0.0 and ``no-grade``."""
    last = (grades.groupBy("query_id", "chunk_id")
            .agg(F.max_by(F.struct("grade", "reason"), "elem").alias("_g")))
    j = graded.join(last, ["query_id", "chunk_id"], "left")
    ok = (F.col("ord") <= max_items) & F.col("_g").isNotNull()
    return (j.withColumn("grade", F.when(ok, F.col("_g.grade")).otherwise(F.lit(0.0)))
            .withColumn("grade_reason", F.when(ok, F.col("_g.reason")).otherwise(F.lit("no-grade")))
            .drop("_g"))


def apply_grades(strips: DataFrame, grades: DataFrame, max_items: int = Settings().grade_max_items) -> DataFrame:
    """G3 for a grader's rows (query_id, chunk_id, grade[, elem | ord][, reason | grade_reason]).

    A chunk graded twice counts once, with its last grade, so a strip is never repeated.
    """
    place = next((c for c in ("elem", "ord") if c in grades.columns), None)
    reason = next((c for c in ("reason", "grade_reason") if c in grades.columns), None)
    g = grades.select("query_id", "chunk_id", "grade", (F.col(place) if place else F.lit(0)).alias("elem"),
                      (F.col(reason) if reason else F.lit("")).alias("reason"))
    return align_grades(strips.drop("grade", "grade_reason"), g, max_items)


def lexical_grades(queries: DataFrame, strips: DataFrame, query_col: str = "query",
                   text_col: str = "content") -> DataFrame:
    """G4 (stand-in for the grading model): share of the query's distinct words found in the strip."""
    q = queries.select("query_id", F.array_distinct(words_of(query_col)).alias("_qw"))
    s = strips.join(q, "query_id")
    hit = F.size(F.array_intersect("_qw", F.array_distinct(words_of(text_col))))
    g = F.when(F.size("_qw") > 0, hit / F.size("_qw")).otherwise(F.lit(0.0))
    return s.withColumn("grade", g.cast("double")).withColumn("grade_reason", F.lit("lexical overlap")).drop("_qw")


def needs_correction(graded: DataFrame, threshold: float = Settings().grade_threshold) -> DataFrame:
    """Queries whose best grade is below the threshold."""
    return (graded.groupBy("query_id").agg(F.max(F.coalesce("grade", F.lit(0.0))).alias("best_grade"))
            .filter(F.col("best_grade") < F.lit(threshold)))


def rewrite_prompts(queries: DataFrame, n: int = Settings().num_rewrites, query_col: str = "query") -> DataFrame:
    """One prompt per query asking for ``n`` rewrites."""
    prompt = F.concat(F.lit(REWRITE_HEAD.format(n=n)), F.lit(REWRITE_BODY), F.lit("Query: "), F.col(query_col),
                      F.lit("\n"))
    return queries.select(F.col("query_id").alias("request_id"), prompt.alias("prompt"))


def parse_rewrites(completions: DataFrame, n: int = Settings().num_rewrites, key: str = "request_id",
                   text_col: str = "text") -> DataFrame:
    """The completion must be a JSON array as a whole (no fence removal); string, number and
    boolean elements become text (``True``, ``False``), others are skipped; the first ``n`` are kept."""
    v = completions.select(key, whole_json(tx.strip(text_col)).alias("_v"))
    elems = v.select(key, F.posexplode(F.try_variant_get("_v", "$", "array<variant>")).alias("_p", "_e"))
    kind = F.schema_of_variant("_e")
    ok = kind.isin("STRING", "BOOLEAN", "BIGINT", "DOUBLE", "INT", "SMALLINT", "TINYINT", "FLOAT") | \
        kind.startswith("DECIMAL")
    text = F.try_variant_get("_e", "$", "string")
    kept = elems.filter(ok).select(key, "_p", F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text).alias("rewrite"))
    w = Window.partitionBy(key).orderBy("_p")
    return (kept.withColumn("rewrite_no", F.row_number().over(w)).filter(F.col("rewrite_no") <= n)
            .select(key, F.col("rewrite_no").cast("long").alias("rewrite_no"), "rewrite"))


def keyword_rewrites(queries: DataFrame, n: int = Settings().num_rewrites, query_col: str = "query") -> DataFrame:
    """G8 (stand-in for the rewriting model): (1) the query without stop words, (2) its three
    longest distinct words (ties by first position). Empty rewrites are dropped."""
    words = words_of(query_col)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    content = F.filter(words, lambda w: ~F.array_contains(stop, w))
    r1 = F.array_join(content, " ")
    distinct = F.array_distinct(words)
    ranked = F.array_sort(F.transform(distinct, lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"),
                                                                       w.alias("w"))))
    r2 = F.array_join(F.transform(F.slice(ranked, 1, 3), lambda s: s["w"]), " ")
    rows = queries.select("query_id", "task_id", F.posexplode(F.slice(F.array(r1, r2), 1, n)).alias("_p", "rewrite"))
    return (rows.filter(F.col("rewrite") != "")
            .select("query_id", "task_id", (F.col("_p") + 1).cast("long").alias("rewrite_no"), "rewrite"))


def corrective_merge(graded: DataFrame, rewrite_hits: DataFrame) -> DataFrame:
    """Append hits of the rewrites whose chunk is not present yet, in (rewrite, rank)
    order; the first occurrence wins; ``ord`` continues after the graded strips."""
    new = rewrite_hits.join(graded.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    w1 = Window.partitionBy("query_id", "chunk_id").orderBy("rewrite_no", "rank")
    new = new.withColumn("_r", F.row_number().over(w1)).filter("_r = 1").drop("_r")
    top = graded.groupBy("query_id").agg(F.max("ord").alias("_top"))
    w2 = Window.partitionBy("query_id").orderBy("rewrite_no", "rank")
    new = (new.join(top, "query_id", "left")
           .withColumn("ord", (F.coalesce("_top", F.lit(0)) + F.row_number().over(w2)).cast("long"))
           .withColumn("score", F.col("similarity_score")).drop("_top"))
    keep = [c for c in graded.columns if c in new.columns]
    return graded.unionByName(new.select(*keep), allowMissingColumns=True)


def corrective_rounds(queries: DataFrame, graded: DataFrame, retrieve: Callable[[DataFrame], DataFrame],
                      grade: Callable[[DataFrame, DataFrame], DataFrame],
                      rewrite: Callable[[DataFrame], DataFrame] = keyword_rewrites,
                      cfg: Settings = Settings()) -> DataFrame:
    """For queries whose best grade is below the threshold: rewrite -> retrieve -> merge ->
    grade the first ``grade_max_items`` again (all grades replaced, others 0) -> stop when good.

    At most ``max_rounds`` rounds (a small, fixed bound); each round is one DataFrame plan over
    the still-weak queries, and its result is checkpointed to cut lineage.
    """
    done = graded
    for _ in range(cfg.max_rounds):
        weak = needs_correction(done, cfg.grade_threshold).select("query_id")
        wq = queries.join(weak, "query_id", "left_semi")
        rw = rewrite(wq)
        hits = retrieve(rw)  # (query_id, rewrite_no, chunk_id, content, similarity_score, rank, ...)
        weak_graded = done.join(weak, "query_id", "left_semi").drop("grade", "grade_reason")
        merged = corrective_merge(weak_graded, hits)
        g = apply_grades(merged, grade(wq, merged.filter(F.col("ord") <= cfg.grade_max_items)), cfg.grade_max_items)
        strong = done.join(weak, "query_id", "left_anti")
        done = checkpoint(strong.unionByName(g, allowMissingColumns=True))
    return done


def select_strips(graded: DataFrame, k: int = Settings().k) -> DataFrame:
    """Order by (grade, score) descending — list order on ties — and keep k."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("grade", F.lit(0.0))),
                                               F.desc(F.coalesce("score", F.lit(0.0))), "ord")
    return graded.withColumn("final_rank", F.row_number().over(w)).filter(F.col("final_rank") <= k)
