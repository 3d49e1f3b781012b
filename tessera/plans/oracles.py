"""DuckDB twins of the registered queries (same tables, same bindings, same column names).

Shared bindings are CTE fragments; each twin is one SELECT statement.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    ORACLES[name] = text.strip()


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


# ---------------------------------------------------------------- bindings
VECTORS = """
vectors AS (
  SELECT 't' || CAST(vec_id % 5 AS VARCHAR) AS task_id, CAST(vec_id AS BIGINT) AS vec_id,
         'c' || CAST(vec_id AS VARCHAR) AS chunk_id, 'vec ' || CAST(vec_id AS VARCHAR) AS content,
         CAST(embedding AS DOUBLE[]) AS vec, CAST(label AS INTEGER) AS label
  FROM embeddings)"""

NORMED = """
normed AS (
  SELECT task_id, vec_id, chunk_id, content, label,
         list_transform(vec, lambda x: x / nrm) AS vn
  FROM (SELECT *, sqrt(list_sum(list_transform(vec, lambda y: y * y))) + 1e-12 AS nrm FROM vectors))"""

RENORMED = """
renormed AS (
  SELECT task_id, vec_id, chunk_id, content, label, vn,
         list_transform(vn, lambda x: x / nrm2) AS vnn
  FROM (SELECT *, sqrt(list_sum(list_transform(vn, lambda y: y * y))) + 1e-12 AS nrm2 FROM normed))"""


def topk_cte(k: int = 5) -> str:
    return f"""
topk AS (
  SELECT * FROM (
    SELECT q.vec_id AS query_id, c.task_id, c.vec_id, c.chunk_id, c.content, c.label,
           list_dot_product(q.vn, c.vn) AS raw_score,
           greatest(0.0, least(1.0, list_dot_product(q.vn, c.vn))) AS index_similarity,
           greatest(0.0, least(1.0, list_dot_product(q.vnn, c.vnn))) AS similarity_score,
           row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.vn, c.vn) DESC, c.vec_id) AS rk
    FROM renormed q JOIN renormed c ON q.task_id = c.task_id)
  WHERE rk <= {k})"""


def f2_cte(k: int = 5, threshold: float = 0.2) -> str:
    return f"""
f2 AS (
  SELECT query_id, task_id, vec_id, chunk_id, content, similarity_score, index_similarity,
         label AS cluster_id,
         row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC, vec_id) AS rank
  FROM topk WHERE similarity_score >= {threshold})"""


sql("vector_topk", with_(VECTORS, NORMED, RENORMED, topk_cte(5)) + """
SELECT query_id, task_id, vec_id, CAST(rk AS BIGINT) AS rank, round(index_similarity, 6) AS index_similarity
FROM topk""")

sql("vector_topk_cells", ORACLES["vector_topk"])

sql("search_similar", with_(VECTORS, NORMED, RENORMED, topk_cte(5), f2_cte(5, 0.2)) + """
SELECT query_id, task_id, chunk_id, content, round(similarity_score, 6) AS similarity_score,
       round(index_similarity, 6) AS index_similarity, CAST(cluster_id AS BIGINT) AS cluster_id,
       CAST(rank AS BIGINT) AS rank
FROM f2""")

GRADED_F2 = """
graded_f2 AS (
  SELECT *, similarity_score AS score,
         CASE WHEN vec_id % 2 = 0 THEN ((vec_id * 37) % 101) / 100.0 END AS grade
  FROM f2)"""


def evidence_line_expr(prefix: str = "") -> str:
    p = prefix
    return (f"'[' || coalesce({p}chunk_id, '') || '] (' || "
            f"CASE WHEN {p}grade IS NOT NULL THEN 'grade ' || printf('%.2f', {p}grade) || ', ' ELSE '' END || "
            f"'sim ' || printf('%.2f', coalesce({p}score, 0.0)) || ', cl ' || "
            f"coalesce(CAST({p}cluster_id AS VARCHAR), '-') || ') ' || coalesce({p}content, '')")


def digest_cte(name: str, lines: str, order: str, chars: int = 2000, piece: int = 30) -> str:
    """The offline digest: the joined lines, or over budget the pieces of sentences that a greedy choice takes, step by step."""
    return f"""{name}_l AS (
  SELECT query_id, {order} AS o, line, sum(length(line)) OVER (PARTITION BY query_id) + count(*) OVER (PARTITION BY query_id) - 1 AS total
  FROM {lines}),
{name}_s AS (
  SELECT query_id, o, i, regexp_split_to_array(segs[i + 1], '\\s+') AS toks
  FROM (SELECT query_id, o, segs, unnest(range(len(segs))) AS i FROM (SELECT *, {seg_list_expr('line')} AS segs FROM {name}_l WHERE total > {chars}))),
{name}_t AS (
  SELECT query_id, o, i, w, array_to_string(toks[w + 1:w + {piece}], ' ') AS text
  FROM (SELECT *, unnest(range(0, len(toks), {piece})) AS w FROM {name}_s)),
{name}_p AS MATERIALIZED (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY o, i, w) AS p, text, length(text) AS n,
         list_distinct({words_sql('text')}) AS words, count(*) OVER (PARTITION BY query_id) AS pieces FROM {name}_t),
{name}_v AS (
  SELECT query_id, w, 1000 * any_value(pieces) // count(*) AS v FROM (SELECT query_id, pieces, unnest(words) AS w FROM {name}_p) GROUP BY query_id, w),
{name}_c AS MATERIALIZED (
  SELECT p.query_id, p.p, any_value(p.n) AS n, list({{'w': v.w, 'v': v.v}}) AS worths
  FROM (SELECT *, unnest(words) AS w FROM {name}_p) p JOIN {name}_v v ON v.query_id = p.query_id AND v.w = p.w GROUP BY p.query_id, p.p),
{name}_g AS (
  SELECT DISTINCT query_id, {chars} + 1 AS room, CAST([] AS BIGINT[]) AS chosen, CAST([] AS VARCHAR[]) AS covered, 0 AS step FROM {name}_p
  UNION ALL
  SELECT query_id, room - n - 1, list_append(chosen, p), list_concat(covered, list_transform(worths, lambda x: x.w)), step + 1 FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, p) AS r FROM (
      SELECT s.query_id, s.room, s.chosen, s.covered, s.step, c.p, c.n, c.worths,
             coalesce(list_sum(list_transform(list_filter(c.worths, lambda x: NOT list_contains(s.covered, x.w)), lambda x: x.v)), 0)
             * 1000000 // c.n AS gain
      FROM {name}_g s JOIN {name}_c c ON c.query_id = s.query_id AND c.n + 1 <= s.room AND NOT list_contains(s.chosen, c.p)))
  WHERE r = 1 AND gain > 0),
{name}_d AS (
  SELECT g.query_id, string_agg(p.text, chr(10) ORDER BY p.p) AS digest
  FROM (SELECT query_id, unnest(chosen) AS p FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY step DESC) AS r FROM {name}_g) WHERE r = 1) g
  JOIN {name}_p p ON p.query_id = g.query_id AND p.p = g.p GROUP BY g.query_id),
{name} AS (
  SELECT l.query_id, CASE WHEN any_value(l.total) <= {chars} THEN string_agg(l.line, chr(10) ORDER BY l.o)
                          ELSE coalesce(any_value(d.digest), substring(string_agg(l.line, chr(10) ORDER BY l.o), 1, {chars})) END AS evidence
  FROM {name}_l l LEFT JOIN {name}_d d ON d.query_id = l.query_id GROUP BY l.query_id)"""


sql("evidence_lines", with_(VECTORS, NORMED, RENORMED, topk_cte(5), f2_cte(5, 0.2), GRADED_F2) + f"""
SELECT query_id, CAST(rank AS BIGINT) AS rank, {evidence_line_expr()} AS line
FROM graded_f2""")


# ---------------------------------------------------------------- text bindings
TRANSCRIPTS = """
transcripts AS (SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS task_id, text, lang FROM documents)"""

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def seg_list_expr(col: str = "text") -> str:
    """B1 twin: marker replacement (no look-behind in RE2), one split, strip, drop empties."""
    marked = (f"regexp_replace(regexp_replace(regexp_replace({col}, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), "
              f"'([.!?])\\s*\\n\\s*', '\\1' || chr(1), 'g'), '\\n\\s*\\n', chr(1), 'g')")
    return (f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s, {WS})), "
            f"lambda s: s <> '')")


SEGMENTS = f"""
seg_lists AS (SELECT task_id, {seg_list_expr()} AS segs FROM transcripts),
segments AS (
  SELECT task_id, CAST(i AS BIGINT) AS seg_no, segs[i + 1] AS text
  FROM (SELECT task_id, segs, unnest(range(len(segs))) AS i FROM seg_lists))"""

HEX = "'0123456789abcdef'"


def padded_expr(col: str) -> str:
    return f"(' ' || trim(regexp_replace(lower({col}), '\\s+', ' ', 'g')) || ' ')"


def bucket_ids_expr(p: str) -> str:
    h = f"md5(substring({p}, i, 3))"
    return (f"list_transform(range(1, length({p}) - 1), lambda i: "
            f"((strpos({HEX}, substr({h}, 1, 1)) - 1) * 16 + strpos({HEX}, substr({h}, 2, 1)) - 1) % 64)")


VEC_FROM_IDS = "list_transform(range(64), lambda b: CAST(len(list_filter(ids, lambda x: x = b)) AS DOUBLE))"


def tri_vectors_cte(name: str, source: str, keys: str, text_col: str = "text") -> str:
    """Trigram count vectors of ``source``'s text, keeping ``keys`` and the text."""
    return f"""
{name}_p AS (SELECT {keys}, {text_col}, {padded_expr(text_col)} AS p FROM {source}),
{name}_i AS (SELECT {keys}, {text_col}, {bucket_ids_expr('p')} AS ids FROM {name}_p),
{name} AS (SELECT {keys}, {text_col}, {VEC_FROM_IDS} AS vec FROM {name}_i)"""


def sqn(v: str) -> str:
    return f"list_sum(list_transform({v}, lambda x: x * x))"


def cosine_expr(a: str, b: str) -> str:
    return (f"CASE WHEN {sqn(a)} > 0 AND {sqn(b)} > 0 THEN list_dot_product({a}, {b}) / "
            f"(sqrt({sqn(a)}) * sqrt({sqn(b)})) ELSE 0.0 END")


SEG_SIMS = tri_vectors_cte("seg_vecs", "segments", "task_id, seg_no") + f""",
seg_sims AS (
  SELECT task_id, seg_no, text, vec, CAST(length(regexp_replace(text, '\\s+', ' ', 'g')) AS BIGINT) AS clen,
         CASE WHEN seg_no = 0 THEN NULL ELSE {cosine_expr('pv', 'vec')} END AS sim
  FROM (SELECT *, lag(vec) OVER (PARTITION BY task_id ORDER BY seg_no) AS pv FROM seg_vecs))"""


def thr_expr(p: str = "f.") -> str:
    return (f"(CASE WHEN {p}cnt < 2 THEN 0.65 ELSE greatest(0.3, least(0.9, 0.65 - 0.1 * sqrt(greatest(0.0, "
            f"{p}s2 / {p}k - ({p}s1 / {p}k) * ({p}s1 / {p}k))))) END)")


FOLD = f"""
fold AS (
  SELECT task_id, seg_no AS i, 1 AS cnt, 0 AS k, CAST(0.0 AS DOUBLE) AS s1, CAST(0.0 AS DOUBLE) AS s2,
         CAST(clen AS BIGINT) AS len, CAST(NULL AS DOUBLE) AS thr, 0 AS grp
  FROM seg_sims WHERE seg_no = 0
  UNION ALL
  SELECT task_id, i,
         CASE WHEN ext THEN cnt + 1 ELSE 1 END, CASE WHEN ext THEN k + 1 ELSE 0 END,
         CASE WHEN ext THEN s1 + sim ELSE 0.0 END, CASE WHEN ext THEN s2 + sim * sim ELSE 0.0 END,
         CASE WHEN ext THEN len + 1 + clen ELSE clen END, t, CASE WHEN ext THEN grp ELSE grp + 1 END
  FROM (SELECT f.task_id, x.seg_no AS i, f.cnt, f.k, f.s1, f.s2, f.len, f.grp, x.sim, x.clen,
               {thr_expr()} AS t,
               (x.sim > {thr_expr()} AND f.len + 1 + x.clen <= 2000) AS ext
        FROM fold f JOIN seg_sims x ON x.task_id = f.task_id AND x.seg_no = f.i + 1)),
groups AS (SELECT task_id, grp, min(i) AS first_i, max(i) AS last_i FROM fold GROUP BY task_id, grp),
chunk_rows AS (
  SELECT g.task_id, g.grp, g.first_i AS seg_start, f.cnt AS segment_count, f.len,
         CASE WHEN nx.i IS NOT NULL THEN nx.thr ELSE coalesce(f.thr, 0.65) END AS thr
  FROM groups g JOIN fold f ON f.task_id = g.task_id AND f.i = g.last_i
  LEFT JOIN fold nx ON nx.task_id = g.task_id AND nx.i = g.last_i + 1),
kept AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY grp) - 1 AS chunk_index
         FROM chunk_rows WHERE len >= 100),
chunks0 AS (
  SELECT k.task_id, k.chunk_index, k.seg_start, k.segment_count, k.thr,
         trim(regexp_replace(string_agg(s.text, ' ' ORDER BY s.seg_no), '\\s+', ' ', 'g')) AS content
  FROM kept k JOIN segments s ON s.task_id = k.task_id AND s.seg_no >= k.seg_start
                             AND s.seg_no < k.seg_start + k.segment_count
  GROUP BY k.task_id, k.chunk_index, k.seg_start, k.segment_count, k.thr),
chunks AS (
  SELECT task_id, task_id || '_semantic_chunk_' || CAST(chunk_index AS VARCHAR) AS chunk_id,
         CAST(chunk_index AS BIGINT) AS chunk_index, CAST(seg_start AS BIGINT) AS seg_start,
         CAST(segment_count AS BIGINT) AS segment_count, CAST(len(string_split(content, ' ')) AS BIGINT) AS word_count,
         CAST(length(content) AS BIGINT) AS character_count, thr AS similarity_threshold_used, content
  FROM chunks0)"""


def with_rec(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes)


CHUNK_CTES = (TRANSCRIPTS, SEGMENTS, SEG_SIMS, FOLD)

sql("split_segments", with_(TRANSCRIPTS, SEGMENTS) + """
SELECT task_id, seg_no, text, CAST(length(text) AS BIGINT) AS n_chars FROM segments""")

sql("merge_text", with_(TRANSCRIPTS, SEGMENTS) + """
, merged AS (SELECT task_id, trim(regexp_replace(array_to_string(segs, ' '), '\\s+', ' ', 'g')) AS m FROM seg_lists)
SELECT task_id, CAST(length(m) AS BIGINT) AS merged_chars, md5(m) AS merged_md5 FROM merged""")

sql("content_key", with_(TRANSCRIPTS) + """
SELECT task_id, md5(text) AS content_key FROM transcripts""")

sql("contains_ci", """
WITH parts AS (SELECT CAST(item_id AS BIGINT) AS query_id, 'word' AS part, string_split_regex(trim(text), '\\s+')[1] AS q FROM benchmark
               UNION ALL SELECT CAST(item_id AS BIGINT), 'text', text FROM benchmark)
SELECT w.query_id, w.part, CAST(count(d.doc_id) AS BIGINT) AS n_docs
FROM parts w LEFT JOIN documents d ON contains(lower(d.text), lower(w.q))
GROUP BY w.query_id, w.part""")

sql("contains_ci_indexed", ORACLES["contains_ci"])

sql("clip_text", with_(TRANSCRIPTS) + """
SELECT task_id, substring(text, 1, 600) AS cut600, substring(text, 1, 400) || '...' AS cut400,
       substring(text, 1, 200) AS cut200, substring(text, 1, 2000) AS cut2000 FROM transcripts""")

sql("load_transcripts", with_(TRANSCRIPTS) + f"""
SELECT task_id, trim(text, {WS}) AS text FROM transcripts""")

sql("transcript_info", with_(TRANSCRIPTS) + f"""
SELECT task_id,
       CAST(CASE WHEN trim(text, {WS}) = '' THEN 0 ELSE len(string_split_regex(trim(text, {WS}), '\\s+')) END AS BIGINT)
         AS word_count,
       CAST(length(text) AS BIGINT) AS character_count,
       CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN suffix(text, chr(10)) THEN 1 ELSE 0 END END
            AS BIGINT) AS line_count,
       CAST(strlen(text) + 1 AS BIGINT) AS file_size
FROM transcripts""")

sql("video_catalog", """
WITH p AS (SELECT page_id, url, html, regexp_replace(html, '<[^>]*>', '', 'g') AS d,
                  nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS t,
                  nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1), '') AS h FROM pages)
SELECT page_id, coalesce(t, 'Unknown Title') AS title, CAST(0 AS BIGINT) AS duration, coalesce(h, 'Unknown') AS uploader,
       'Unknown' AS upload_date, substring(d, 1, 500) || CASE WHEN d <> '' THEN '...' ELSE '' END AS description,
       '' AS thumbnail, url
FROM p""")

# ---------------------------------------------------------------- embedding, vector scalars
sql("embed_texts", with_(TRANSCRIPTS, tri_vectors_cte("doc_vecs", "transcripts", "task_id")) + """
SELECT task_id, vec FROM doc_vecs""")

sql("embed_distinct", with_(TRANSCRIPTS, tri_vectors_cte("doc_vecs", "transcripts", "task_id")) + """
SELECT task_id, md5(text) AS content_key, vec FROM doc_vecs""")

sql("embed_cached", with_(TRANSCRIPTS, tri_vectors_cte("doc_vecs", "transcripts", "task_id")) + """
SELECT task_id, md5(text) AS content_key, vec FROM doc_vecs""")

sql("cache_stats", with_(TRANSCRIPTS) + """
SELECT CAST(count(DISTINCT md5(text)) AS BIGINT) AS cache_size, CAST(64 AS BIGINT) AS embedding_dimension,
       'hashed-trigram-64' AS model_name FROM transcripts""")

PAIRS = """
pairs AS (SELECT a.vec_id, b.vec_id AS next_id, a.vec AS vec, b.vec AS vec2
          FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1)"""


def norm_expr(v: str) -> str:
    return f"list_transform({v}, lambda x: x / (sqrt({sqn(v)}) + 1e-12))"


def r6list(v: str) -> str:
    return f"list_transform({v}, lambda x: round(x, 6))"


sql("l2_normalize", with_(VECTORS) + f"""
SELECT vec_id, {r6list(norm_expr('vec'))} AS vec FROM vectors""")

sql("cosine_similarity", with_(VECTORS, PAIRS) + f"""
SELECT vec_id, next_id, round({cosine_expr('vec', 'vec2')}, 6) AS cosine FROM pairs""")

sql("inner_product_clip", with_(VECTORS, PAIRS) + f"""
SELECT vec_id, next_id,
       round(greatest(0.0, least(1.0, list_dot_product({norm_expr('vec')}, {norm_expr('vec2')}))), 6) AS ip01
FROM pairs""")

CENTERS = """
centers AS (
  SELECT label, list(m ORDER BY pos) AS center FROM (
    SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM vectors)
    GROUP BY label, pos)
  GROUP BY label)"""

sql("centroid", with_(VECTORS, CENTERS) + f"""
SELECT CAST(label AS BIGINT) AS label, {r6list('center')} AS center FROM centers""")

sql("blend_vectors", with_(VECTORS, CENTERS) + f"""
, b AS (SELECT v.vec_id, list_transform(list_zip({norm_expr('v.vec')}, c.center), lambda z: z[1] + 0.5 * z[2]) AS s
        FROM vectors v JOIN centers c ON c.label = v.label)
SELECT vec_id, {r6list(norm_expr('s'))} AS blended FROM b""")

sql("check_dimension", with_(VECTORS) + """
SELECT CASE WHEN len(vec) = 64 THEN 'ok' ELSE 'rejected' END AS status, CAST(count(*) AS BIGINT) AS n
FROM vectors GROUP BY 1""")

sql("consecutive_similarity", with_(TRANSCRIPTS, SEGMENTS, SEG_SIMS) + """
SELECT task_id, seg_no, round(sim, 6) AS sim_prev FROM seg_sims""")

# ---------------------------------------------------------------- chunking
sql("adaptive_threshold", with_(TRANSCRIPTS, SEGMENTS, SEG_SIMS) + """
SELECT task_id, CAST(count(*) AS BIGINT) AS n_segments,
       round(CASE WHEN count(*) < 2 THEN 0.65
                  ELSE greatest(0.3, least(0.9, 0.65 - 0.1 * coalesce(stddev_pop(sim), 0.0))) END, 6) AS threshold
FROM seg_sims GROUP BY task_id""")

sql("semantic_chunks", with_rec(*CHUNK_CTES) + """
SELECT task_id, chunk_id, chunk_index, seg_start, segment_count, word_count, character_count,
       round(similarity_threshold_used, 6) AS similarity_threshold_used, content
FROM chunks""")

sql("chunk_stats", with_rec(*CHUNK_CTES) + """
SELECT task_id, CAST(count(*) AS BIGINT) AS total_chunks, round(avg(word_count), 6) AS avg_chunk_size_words,
       CAST(min(word_count) AS BIGINT) AS min_chunk_size_words, CAST(max(word_count) AS BIGINT) AS max_chunk_size_words,
       round(avg(segment_count), 6) AS avg_segments_per_chunk, 'semantic_dynamic' AS chunking_strategy,
       0.65 AS base_similarity_threshold
FROM chunks GROUP BY task_id""")

# ---------------------------------------------------------------- store
sql("write_chunk_store", with_(VECTORS) + f"""
SELECT task_id, vec_id, chunk_id, content, {r6list(norm_expr('vec'))} AS vec FROM vectors""")

sql("load_chunk_store", with_(VECTORS) + """
SELECT task_id, CAST(count(*) AS BIGINT) AS n_vectors, CAST(max(vec_id) + 1 AS BIGINT) AS next_id
FROM vectors GROUP BY task_id""")

sql("delete_tasks", with_(VECTORS) + """
, req AS (SELECT DISTINCT 't' || CAST(label % 7 AS VARCHAR) AS task_id FROM embeddings),
ids AS (SELECT task_id FROM req UNION SELECT task_id FROM vectors)
SELECT i.task_id,
       (i.task_id IN (SELECT task_id FROM req) AND i.task_id IN (SELECT task_id FROM vectors)) AS removed,
       CAST(CASE WHEN i.task_id IN (SELECT task_id FROM req) THEN 0
                 ELSE (SELECT count(*) FROM vectors v WHERE v.task_id = i.task_id) END AS BIGINT) AS n_remaining
FROM ids i""")

sql("export_docs", with_(VECTORS) + """
SELECT task_id, vec_id,
       CAST(to_json({'content': content, 'metadata': {'task_id': task_id, 'chunk_id': chunk_id}}) AS VARCHAR) AS doc_json
FROM vectors""")

sql("assign_vector_ids", with_(VECTORS) + """
, existing AS (SELECT task_id, vec_id AS src_id,
                      CAST(row_number() OVER (PARTITION BY task_id ORDER BY vec_id) - 1 AS BIGINT) AS vec_id
               FROM vectors WHERE label < 5),
nxt AS (SELECT task_id, max(vec_id) + 1 AS n FROM existing GROUP BY task_id),
appended AS (SELECT v.task_id, v.vec_id AS src_id,
                    CAST(coalesce(n.n, 0) + row_number() OVER (PARTITION BY v.task_id ORDER BY v.vec_id) - 1 AS BIGINT) AS vec_id
             FROM vectors v LEFT JOIN nxt n ON n.task_id = v.task_id WHERE v.label >= 5)
SELECT task_id, src_id, vec_id FROM existing UNION ALL SELECT task_id, src_id, vec_id FROM appended""")

sql("lookup_vectors", with_(VECTORS) + f"""
, req AS (SELECT task_id, vec_id + 5 AS vec_id FROM vectors)
SELECT r.task_id, r.vec_id, v.chunk_id, v.content, CASE WHEN v.vec IS NULL THEN NULL ELSE {r6list('v.vec')} END AS vec
FROM req r LEFT JOIN vectors v ON v.task_id = r.task_id AND v.vec_id = r.vec_id""")


# ---------------------------------------------------------------- clustering
TASK_CENTERS = """
task_centers AS (
  SELECT task_id, label AS cluster_id, list(m ORDER BY pos) AS center FROM (
    SELECT task_id, label, pos, avg(x) AS m
    FROM (SELECT task_id, label, unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM vectors)
    GROUP BY task_id, label, pos)
  GROUP BY task_id, label)"""


def sqdist(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


ASSIGNED = f"""
dists AS (SELECT v.task_id, v.vec_id, v.vec, c.cluster_id, {sqdist('v.vec', 'c.center')} AS d2
          FROM vectors v JOIN task_centers c ON c.task_id = v.task_id),
assigned AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id, vec_id ORDER BY d2, cluster_id) AS r
                            FROM dists) WHERE r = 1)"""

sql("assign_clusters", with_(VECTORS, TASK_CENTERS, ASSIGNED) + """
SELECT task_id, vec_id, CAST(cluster_id AS BIGINT) AS cluster_id, round(sqrt(d2), 6) AS distance FROM assigned""")

sql("lloyd_step", with_(VECTORS, TASK_CENTERS, ASSIGNED) + f"""
, moved AS (
  SELECT task_id, cluster_id, list(m ORDER BY pos) AS center FROM (
    SELECT task_id, cluster_id, pos, avg(x) AS m
    FROM (SELECT task_id, cluster_id, unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM assigned)
    GROUP BY task_id, cluster_id, pos)
  GROUP BY task_id, cluster_id),
cnt AS (SELECT task_id, cluster_id, count(*) AS n FROM assigned GROUP BY task_id, cluster_id),
inertia AS (SELECT task_id, sum(d2) AS inertia FROM assigned GROUP BY task_id)
SELECT c.task_id, CAST(c.cluster_id AS BIGINT) AS cluster_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_members,
       {r6list('coalesce(m.center, c.center)')} AS center, round(i.inertia, 6) AS inertia
FROM task_centers c LEFT JOIN moved m USING (task_id, cluster_id) LEFT JOIN cnt n USING (task_id, cluster_id)
JOIN inertia i USING (task_id)""")

def kmeans_sql(k: int = 5, n_init: int = 10, iters: int = 20, seed: int = 42, tol: float = 1e-4) -> str:
    """k-means from hashed seeds: one pair of CTEs per Lloyd round, then the start with the least inertia."""
    mean = "SELECT task_id, start, cluster_id, list(m ORDER BY pos) AS center FROM (SELECT task_id, start, cluster_id, pos, avg(x) AS m " \
           "FROM (SELECT task_id, start, cluster_id, unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM a{r}) GROUP BY ALL) GROUP BY ALL"
    near = f"""a{{r}} AS MATERIALIZED (
  SELECT task_id, start, vec_id, vec, cluster_id, d2 FROM (
    SELECT *, row_number() OVER (PARTITION BY task_id, start, vec_id ORDER BY d2, cluster_id) AS rn FROM (
      SELECT c.task_id, c.start, v.vec_id, v.vec, c.cluster_id, {sqdist('v.vec', 'c.center')} AS d2
      FROM vectors v JOIN c{{r}} c ON c.task_id = v.task_id{{only}})) WHERE rn = 1)"""
    ctes = [f"""ok AS (SELECT task_id FROM vectors GROUP BY task_id HAVING count(*) > {k} AND count(DISTINCT vec) >= 2),
tols AS (SELECT task_id, avg(v) * {tol} AS tol FROM (
  SELECT task_id, pos, var_pop(x) AS v FROM (SELECT task_id, unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM vectors)
  GROUP BY task_id, pos) GROUP BY task_id),
c0 AS MATERIALIZED (
  SELECT task_id, start, CAST(r - 1 AS INTEGER) AS cluster_id, vec AS center, false AS done FROM (
    SELECT v.task_id, s.start, v.vec,
           row_number() OVER (PARTITION BY v.task_id, s.start ORDER BY md5('{seed}:' || s.start || ':' || v.vec_id), v.vec_id) AS r
    FROM vectors v JOIN ok USING (task_id), (SELECT unnest(range({n_init})) AS start) s) WHERE r <= {k})"""]
    for r in range(iters):
        ctes.append(near.format(r=r, only=" AND NOT c.done"))
        ctes.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT task_id, start, cluster_id, center, done OR max({sqdist('center', 'old')}) OVER (PARTITION BY task_id, start) <= tol AS done FROM (
    SELECT c.task_id, c.start, c.cluster_id, c.center AS old, coalesce(m.center, c.center) AS center, c.done, t.tol
    FROM c{r} c LEFT JOIN ({mean.format(r=r)}) m USING (task_id, start, cluster_id) JOIN tols t ON t.task_id = c.task_id))""")
    ctes.append(near.format(r=iters, only=""))
    ctes.append("""best AS (SELECT task_id, start FROM (
  SELECT task_id, start, row_number() OVER (PARTITION BY task_id ORDER BY CAST(printf('%.9e', i) AS DOUBLE), start) AS rn FROM (
    SELECT task_id, start, sum(d2) AS i FROM a""" + str(iters) + """ GROUP BY task_id, start)) WHERE rn = 1)""")
    return with_(VECTORS, *ctes) + f"""
SELECT task_id, vec_id, CAST(cluster_id AS BIGINT) AS cluster_id FROM a{iters} JOIN best USING (task_id, start)"""


sql("kmeans_by_task", kmeans_sql())

sql("kmeans_distributed", kmeans_sql())

SILHOUETTE = f"""
pair_d AS (SELECT a.task_id, a.vec_id, a.label AS own, b.label AS other, sqrt({sqdist('a.vec', 'b.vec')}) AS d
           FROM vectors a JOIN vectors b ON a.task_id = b.task_id AND a.vec_id <> b.vec_id),
per_cluster AS (SELECT task_id, vec_id, own, other, avg(d) AS md FROM pair_d GROUP BY ALL),
per_point AS (SELECT task_id, vec_id, max(CASE WHEN own = other THEN md END) AS a,
                     min(CASE WHEN own <> other THEN md END) AS b FROM per_cluster GROUP BY task_id, vec_id),
point_s AS (SELECT v.task_id, v.vec_id,
                   CASE WHEN p.a IS NULL OR p.b IS NULL THEN 0.0
                        WHEN greatest(p.a, p.b) > 0 THEN (p.b - p.a) / greatest(p.a, p.b) ELSE 0.0 END AS s
            FROM vectors v LEFT JOIN per_point p USING (task_id, vec_id)),
sil AS (SELECT task_id, avg(s) AS silhouette_score FROM point_s GROUP BY task_id)"""

sql("silhouette", with_(VECTORS, SILHOUETTE) + """
SELECT task_id, round(silhouette_score, 6) AS silhouette_score FROM sil""")

sql("cluster_members", with_(VECTORS) + """
SELECT task_id, CAST(label AS BIGINT) AS cluster_id, CAST(count(*) AS BIGINT) AS n_members,
       min(chunk_id) AS first_member, max(chunk_id) AS last_member
FROM vectors GROUP BY task_id, label""")

INDEX_META = """
index_meta AS (
  SELECT v.task_id, CAST(count(*) AS BIGINT) AS total_chunks, 'hashed-trigram-64' AS embedding_model,
         CAST(max(len(v.vec)) AS BIGINT) AS embedding_dimension, CAST(512 AS BIGINT) AS chunk_size,
         CAST(64 AS BIGINT) AS chunk_overlap, CAST(count(DISTINCT v.label) AS BIGINT) AS n_clusters,
         any_value(s.silhouette_score) AS silhouette_score, 'exact-inner-product' AS index_type,
         CAST(NULL AS VARCHAR) AS cluster_error
  FROM vectors v LEFT JOIN sil s USING (task_id) GROUP BY v.task_id)"""

sql("index_metadata", with_(VECTORS, SILHOUETTE, INDEX_META) + """
SELECT task_id, total_chunks, embedding_model, embedding_dimension, chunk_size, chunk_overlap, n_clusters,
       round(silhouette_score, 6) AS silhouette_score, index_type, cluster_error FROM index_meta""")

sql("index_statistics", with_(VECTORS, SILHOUETTE, INDEX_META) + """
, req AS (SELECT DISTINCT 't' || CAST(label % 7 AS VARCHAR) AS task_id FROM embeddings)
SELECT task_id, total_chunks, embedding_model, chunk_size, chunk_overlap, n_clusters,
       round(coalesce(silhouette_score, 0.0), 6) AS silhouette_score, index_type
FROM index_meta WHERE task_id IN (SELECT task_id FROM req)""")

WORDS = """
words AS (SELECT CAST(item_id AS BIGINT) AS query_id, 'word' AS part, string_split_regex(trim(text), '\\s+')[1] AS word FROM benchmark
          UNION ALL SELECT CAST(item_id AS BIGINT), 'text', text FROM benchmark)"""

sql("search_by_cluster", with_rec(*CHUNK_CTES, WORDS) + """
SELECT w.query_id, w.part, c.chunk_id, CAST(c.chunk_index % 5 AS BIGINT) AS cluster_id, 'text' AS match_type
FROM chunks c JOIN words w ON contains(lower(c.content), lower(w.word))""")


# ---------------------------------------------------------------- text corpus, memory
def nrm(v: str) -> str:
    return f"list_transform({v}, lambda x: x / (sqrt({sqn(v)}) + 1e-12))"


CORPUS = tri_vectors_cte("corpus_vecs", """(SELECT 'all' AS task_id,
       CAST(substring(task_id, 5) AS BIGINT) * 4294967296 + chunk_index AS vec_id, chunk_id,
       CAST(chunk_index % 5 AS INTEGER) AS cluster_id, content FROM chunks)""",
                         "task_id, vec_id, chunk_id, cluster_id", "content") + f""",
corpus_n AS (SELECT task_id, vec_id, chunk_id, cluster_id, content, {nrm('vec')} AS vn FROM corpus_vecs),
corpus AS (SELECT *, {nrm('vn')} AS vnn FROM corpus_n)"""


def query_vecs_cte(name: str, source: str, keys: str, text_col: str = "query") -> str:
    """Queries embedded and normalised once (qn) and twice (qnn), as the search does."""
    return tri_vectors_cte(f"{name}_v", source, keys, text_col) + f""",
{name}_n AS (SELECT *, {nrm('vec')} AS qn FROM {name}_v),
{name} AS (SELECT *, {nrm('qn')} AS qnn FROM {name}_n)"""


def search_cte(name: str, queries: str, k: int, thr: float, qkeys: str = "q.query_id") -> str:
    return f"""
{name}_raw AS (
  SELECT {qkeys}, c.task_id, c.vec_id, c.chunk_id, c.cluster_id, c.content,
         list_dot_product(q.qn, c.vn) AS raw,
         greatest(0.0, least(1.0, list_dot_product(q.qn, c.vn))) AS index_similarity,
         greatest(0.0, least(1.0, list_dot_product(q.qnn, c.vnn))) AS similarity_score
  FROM {queries} q JOIN corpus c ON c.task_id = q.task_id),
{name}_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, vec_id) AS rk
                              FROM {name}_raw) WHERE rk <= {k}),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC, vec_id) AS rank
           FROM {name}_top WHERE similarity_score >= {thr})"""


BENCH_Q = query_vecs_cte("bench_q", "(SELECT CAST(item_id AS BIGINT) AS query_id, 'all' AS task_id, text AS query FROM benchmark)",
                         "query_id, task_id")

sql("retrieve", with_rec(*CHUNK_CTES, CORPUS, BENCH_Q, search_cte("hits", "bench_q", 5, 0.0)) + """
SELECT query_id, chunk_id, round(similarity_score, 6) AS similarity_score, round(index_similarity, 6) AS index_similarity,
       CAST(cluster_id AS BIGINT) AS cluster_id, CAST(rank AS BIGINT) AS rank FROM hits""")

sql("ingest_summary", with_rec(*CHUNK_CTES) + """
SELECT task_id, string_agg(substring(content, 1, 400) || '...', '' ORDER BY chunk_index) AS text,
       'ingest_summary' AS type
FROM chunks WHERE chunk_index < 3 GROUP BY task_id""")

UTURNS = """
uturns AS (
  SELECT CAST(u.conv_id * 4294967296 + u.turn AS BIGINT) AS query_id, 'all' AS task_id,
         'm' || CAST(u.conv_id % 10 AS VARCHAR) AS memory_key, u.conv_id, u.turn, u.text AS query,
         coalesce(a.text, '') AS answer
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'),
upos AS (SELECT *, CAST(2 * (row_number() OVER (PARTITION BY memory_key ORDER BY conv_id, turn) - 1) AS BIGINT) AS pos
         FROM uturns)"""

def memory_cte(uturns: str) -> str:
    """Numbered turns with the memory that they see and write."""
    return uturns + """,
qa_rows AS (
  SELECT memory_key, pos + 1 AS seq, 'query' AS type, query AS text FROM upos
  UNION ALL
  SELECT memory_key, pos + 2 AS seq, 'qa' AS type, 'Q: ' || query || chr(10) || 'A: ' || answer AS text FROM upos),
""" + tri_vectors_cte("qa_vecs", "qa_rows", "memory_key, seq, type") + """,
memory AS (
  SELECT DISTINCT memory_key, CAST(0 AS BIGINT) AS seq, 'ingest_summary' AS type, '' AS text,
         CAST(NULL AS DOUBLE[]) AS vec FROM upos
  UNION ALL SELECT memory_key, CAST(seq AS BIGINT), type, text, vec FROM qa_vecs)"""


MEMORY = memory_cte(UTURNS)

sql("qa_memory_rows", with_(MEMORY) + """
SELECT memory_key, CAST(seq AS BIGINT) AS seq, type, text, vec FROM qa_vecs""")

sql("memory_append", with_(MEMORY) + """
SELECT memory_key, seq, type, text FROM memory""")

sql("memory_recent", with_(MEMORY) + """
SELECT memory_key, seq, type, text FROM (
  SELECT *, row_number() OVER (PARTITION BY memory_key ORDER BY seq DESC) AS r FROM memory) WHERE r <= 10""")


def question_line_sql(col: str) -> str:
    hit = f"list_filter(string_split({col}, chr(10)), lambda l: starts_with(lower(trim(l, {WS})), 'q:'))[1]"
    return f"coalesce(nullif(trim(substring(trim({hit}, {WS}), 3), {WS}), ''), substring({col}, 1, 200))"


sql("question_line", with_(MEMORY) + f"""
SELECT memory_key, seq, {question_line_sql('text')} AS question FROM memory WHERE type IN ('query', 'qa')""")

TURN_Q = query_vecs_cte("turn_q", "upos", "query_id, task_id, memory_key, pos")

CANDS = f"""
cands AS (
  SELECT q.query_id, q.qn, m.memory_key, m.seq, m.type, m.text, m.vec,
         greatest(0.0, least(1.0, list_dot_product(q.qn, {nrm('m.vec')}))) AS sim
  FROM turn_q q JOIN memory m ON m.memory_key = q.memory_key AND m.seq <= q.pos AND m.seq > q.pos - 20
  WHERE m.type IN ('query', 'qa') AND m.vec IS NOT NULL),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, seq) AS pick
                          FROM cands WHERE sim >= 0.5) WHERE pick <= 2)"""

MEM_BASE = (MEMORY, TURN_Q, CANDS)

sql("memory_candidates", with_(*MEM_BASE) + """
SELECT query_id, seq, type, round(sim, 6) AS sim, CAST(pick AS BIGINT) AS pick FROM picked""")

CENTROID_Q = f"""
pmean AS (
  SELECT query_id, list(m ORDER BY pos) AS mv FROM (
    SELECT query_id, pos, avg(x) AS m FROM (
      SELECT query_id, unnest(nv) AS x, unnest(range(len(nv))) AS pos FROM (SELECT query_id, {nrm('vec')} AS nv FROM picked))
    GROUP BY query_id, pos)
  GROUP BY query_id),
cq0 AS (SELECT q.query_id, q.task_id,
               {nrm("list_transform(list_zip(q.qn, p.mv), lambda z: z[1] + 0.5 * z[2])")} AS blended
        FROM turn_q q JOIN pmean p USING (query_id)),
cq1 AS (SELECT query_id, task_id, {nrm('blended')} AS qn FROM cq0),
cen_q AS (SELECT *, {nrm('qn')} AS qnn FROM cq1)"""

SUB_Q = """
subq_src AS (SELECT p.query_id * 100 + p.pick AS query_id, p.query_id AS parent_id, p.pick, 'all' AS task_id, """ + \
    question_line_sql("p.text") + """ AS query FROM picked p),
""" + query_vecs_cte("sub_q", "(SELECT * FROM subq_src WHERE query <> '')", "query_id, parent_id, pick, task_id")

sql("centroid_retrieve", with_rec(*CHUNK_CTES, CORPUS, *MEM_BASE, CENTROID_Q, search_cte("cen_hits", "cen_q", 5, 0.0)) + """
SELECT query_id, chunk_id, round(similarity_score, 6) AS similarity_score, CAST(rank AS BIGINT) AS rank FROM cen_hits""")

sql("subquery_retrieve", with_rec(*CHUNK_CTES, CORPUS, *MEM_BASE, SUB_Q,
                                  search_cte("sub_hits", "sub_q", 2, 0.0, "q.query_id, q.parent_id, q.pick")) + """
SELECT parent_id AS query_id, CAST(pick AS BIGINT) AS pick, chunk_id, round(similarity_score, 6) AS similarity_score,
       CAST(rank AS BIGINT) AS rank FROM sub_hits""")

MERGED = (search_cte("base_hits", "turn_q", 5, 0.0) + "," + CENTROID_Q + "," + search_cte("cen_hits", "cen_q", 5, 0.0) + ","
          + SUB_Q + "," + search_cte("sub_hits", "sub_q", 2, 0.0, "q.query_id, q.parent_id, q.pick") + """,
all_hits AS (
  SELECT query_id, chunk_id, content, cluster_id, similarity_score, index_similarity, rank, 0 AS src_ord FROM base_hits
  UNION ALL SELECT query_id, chunk_id, content, cluster_id, similarity_score, index_similarity, rank, 1 FROM cen_hits
  UNION ALL SELECT parent_id, chunk_id, content, cluster_id, similarity_score, index_similarity, rank, 1 + pick FROM sub_hits),
best_hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id
                                                         ORDER BY similarity_score DESC, src_ord, rank) AS r
                            FROM all_hits WHERE chunk_id IS NOT NULL AND chunk_id <> '') WHERE r = 1),
first_seen AS (SELECT query_id, chunk_id, min(src_ord * 1000 + rank) AS f FROM all_hits GROUP BY query_id, chunk_id),
merged AS (SELECT b.*, row_number() OVER (PARTITION BY b.query_id ORDER BY b.similarity_score DESC, s.f) AS ord
           FROM best_hit b JOIN first_seen s USING (query_id, chunk_id))""")

sql("merge_hits", with_rec(*CHUNK_CTES, CORPUS, *MEM_BASE, MERGED) + """
SELECT query_id, chunk_id, round(similarity_score, 6) AS similarity_score, CAST(ord AS BIGINT) AS ord FROM merged""")


# ---------------------------------------------------------------- corrective, evidence, routing
STRIPS = """
strips AS (SELECT query_id, task_id, vec_id, chunk_id, content, similarity_score, index_similarity,
                  CAST(rk AS BIGINT) AS ord, CAST(rk AS BIGINT) AS rank, similarity_score AS score,
                  ((vec_id * 37) % 101) / 100.0 AS fgrade
           FROM topk)"""

STRIP_BASE = (VECTORS, NORMED, RENORMED, topk_cte(10), STRIPS)

sql("grading_prompts", with_(*STRIP_BASE) + """
SELECT query_id AS request_id,
       'You are a strict relevance grader. For each knowledge strip, output a JSON array where each item has: '
       || '{chunk_id: string, grade: number between 0 and 1, reason: short string}.' || chr(10)
       || 'Grade measures how well the strip helps answer the query.' || chr(10) || chr(10)
       || 'Query: vec ' || CAST(query_id AS VARCHAR) || chr(10) || chr(10) || 'Knowledge strips:' || chr(10)
       || string_agg('- [' || chunk_id || '] ' || substring(content, 1, 600) || chr(10), '' ORDER BY ord)
       || chr(10) || 'Return ONLY valid JSON (array).' AS prompt
FROM strips WHERE ord <= 8 GROUP BY query_id""")


def first_letters_word(col: str) -> str:
    return f"regexp_replace(split_part({col}, ' ', 1), '[^A-Za-z]', '', 'g')"


GRADE_COMPLETIONS = f"""
gitems AS (
  SELECT conv_id, turn,
         '{{"chunk_id": "c' || CAST(turn AS VARCHAR) || '", "grade": '
         || CASE WHEN turn % 3 = 2 THEN '"n/a"' ELSE printf('%.2f', (length(text) % 150) / 100.0) END
         || ', "reason": "' || {first_letters_word('text')} || '"}}' AS item
  FROM conversations),
garr AS (SELECT conv_id, '[' || string_agg(item, ', ' ORDER BY turn) || ']' AS arr FROM gitems GROUP BY conv_id),
gcomp AS (
  SELECT conv_id AS request_id,
         CASE conv_id % 5 WHEN 0 THEN '```json' || chr(10) || arr || chr(10) || '```'
                          WHEN 1 THEN arr
                          WHEN 2 THEN 'Here are the grades: ' || arr || ' Hope this helps.'
                                      || CASE WHEN conv_id % 2 = 0 THEN ' See also [1].' ELSE '' END
                          WHEN 3 THEN substring(arr, 1, length(arr) - 1)
                          ELSE '[7, "text", ' || substring(arr, 2) END AS text
  FROM garr)"""

sql("parse_grades", with_(GRADE_COMPLETIONS) + """
, arrs AS (SELECT request_id, nullif(regexp_extract(text, '(?s)\\[.*\\]', 0), '') AS a FROM gcomp),
valid AS (SELECT request_id, a FROM arrs WHERE a IS NOT NULL AND json_valid(a) AND json_type(a) = 'ARRAY'),
elems AS (SELECT request_id, i, json_extract(a, '$[' || CAST(i AS VARCHAR) || ']') AS e
          FROM (SELECT request_id, a, unnest(range(CAST(json_array_length(a) AS BIGINT))) AS i FROM valid))
SELECT request_id, CAST(i AS BIGINT) AS elem, coalesce(json_extract_string(e, '$.chunk_id'), '') AS chunk_id,
       round(greatest(0.0, least(1.0, coalesce(TRY_CAST(json_extract_string(e, '$.grade') AS DOUBLE), 0.0))), 6) AS grade,
       coalesce(json_extract_string(e, '$.reason'), '') AS reason
FROM elems WHERE json_type(e) = 'OBJECT'""")

sql("align_grades", with_(*STRIP_BASE) + """
, g AS (SELECT query_id, chunk_id, rank AS elem, fgrade AS grade, 'r' || CAST(vec_id AS VARCHAR) AS reason
        FROM strips WHERE vec_id % 3 <> 0
        UNION ALL
        SELECT query_id, chunk_id, rank + 100, fgrade / 2, 'again' FROM strips WHERE vec_id % 4 = 0),
last_g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY elem DESC) AS r FROM g)
           WHERE r = 1)
SELECT s.query_id, s.chunk_id, s.ord,
       round(CASE WHEN s.ord <= 8 AND l.grade IS NOT NULL THEN l.grade ELSE 0.0 END, 6) AS grade,
       CASE WHEN s.ord <= 8 AND l.grade IS NOT NULL THEN l.reason ELSE 'no-grade' END AS grade_reason
FROM strips s LEFT JOIN last_g l USING (query_id, chunk_id)""")


def words_sql(col: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({col}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def lexical_grade_sql(qcol: str, scol: str) -> str:
    qw = f"list_distinct({words_sql(qcol)})"
    return (f"CASE WHEN len({qw}) > 0 THEN CAST(len(list_intersect({qw}, list_distinct({words_sql(scol)}))) AS DOUBLE)"
            f" / len({qw}) ELSE 0.0 END")


TEXT_HITS = (*CHUNK_CTES, CORPUS, BENCH_Q, search_cte("hits", "bench_q", 5, 0.0))

sql("lexical_grades", with_rec(*TEXT_HITS) + f"""
SELECT h.query_id, h.chunk_id, round({lexical_grade_sql('b.text', 'h.content')}, 6) AS grade
FROM hits h JOIN benchmark b ON b.item_id = h.query_id""")

sql("needs_correction", with_(*STRIP_BASE) + """
SELECT query_id, round(max(fgrade), 6) AS best_grade, max(fgrade) < 0.6 AS needs_correction
FROM strips GROUP BY query_id""")

sql("rewrite_prompts", with_(UTURNS) + """
SELECT query_id AS request_id,
       'Rewrite the following user query into 2 alternative concise searches that might retrieve better evidence.'
       || chr(10) || 'Return ONLY a JSON array of strings.' || chr(10) || chr(10) || 'Query: ' || query || chr(10) AS prompt
FROM upos""")

REWRITE_COMPLETIONS = f"""
rw AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN {first_letters_word('text')} END) AS w1,
              max(CASE WHEN turn = 1 THEN {first_letters_word('text')} END) AS w2, count(*) AS n
       FROM conversations GROUP BY conv_id),
rcomp AS (
  SELECT conv_id AS request_id,
         CASE conv_id % 5
           WHEN 0 THEN '```json' || chr(10) || arr || chr(10) || '```'
           WHEN 1 THEN arr
           WHEN 2 THEN CASE WHEN conv_id % 2 = 0 THEN arr || ' Hope this helps.' ELSE 'Sure! ' || arr END
           WHEN 3 THEN '["' || coalesce(w1, '')
           ELSE '[{{"x": 1}}, ' || CASE WHEN conv_id % 2 = 0 THEN 'true, ' ELSE '' END || CAST(conv_id AS VARCHAR) || ', "' || coalesce(w1, '') || '"]' END AS text
  FROM (SELECT *, '["' || coalesce(w1, '') || ' ' || coalesce(w2, '') || '", "' || coalesce(w2, '') || '", '
                  || CAST(n AS VARCHAR) || ']' AS arr FROM rw))"""

sql("parse_rewrites", with_(REWRITE_COMPLETIONS) + f"""
, valid AS (SELECT request_id, trim(text, {WS}) AS a FROM rcomp
            WHERE json_valid(trim(text, {WS})) AND json_type(trim(text, {WS})) = 'ARRAY'),
elems AS (SELECT request_id, i, json_extract(a, '$[' || CAST(i AS VARCHAR) || ']') AS e
          FROM (SELECT request_id, a, unnest(range(CAST(json_array_length(a) AS BIGINT))) AS i FROM valid)),
kept AS (SELECT request_id, i, CASE WHEN json_type(e) = 'VARCHAR' THEN json_extract_string(e, '$')
                                    WHEN json_type(e) = 'BOOLEAN' AND CAST(e AS VARCHAR) = 'true' THEN 'True'
                                    WHEN json_type(e) = 'BOOLEAN' THEN 'False'
                                    ELSE CAST(e AS VARCHAR) END AS rewrite
         FROM elems WHERE json_type(e) IN ('VARCHAR', 'BOOLEAN', 'BIGINT', 'UBIGINT', 'DOUBLE'))
SELECT request_id, CAST(rn AS BIGINT) AS rewrite_no, rewrite FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY i) AS rn FROM kept) WHERE rn <= 2""")

STOP_LIST = ("['a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'de', 'des', 'du', 'en', 'et', 'for', 'from', 'how', "
             "'in', 'is', 'it', 'la', 'le', 'les', 'of', 'on', 'or', 'que', 'qui', 'the', 'to', 'un', 'une', 'was', "
             "'what', 'when', 'where', 'which', 'who', 'why', 'with']")


def keyword_rewrites_cte(src: str, qcol: str = "query") -> str:
    return f"""
kw_w AS (SELECT query_id, task_id, {words_sql(qcol)} AS ws FROM {src}),
kw AS (
  SELECT query_id, task_id,
         array_to_string(list_filter(ws, lambda w: NOT list_contains({STOP_LIST}, w)), ' ') AS r1,
         array_to_string(list_transform(list_sort(list_transform(
             list_filter(ws, lambda w, i: list_position(ws, w) = i),
             lambda w, i: {{'l': -length(w), 'i': i, 'w': w}}))[1:3], lambda s: s.w), ' ') AS r2
  FROM kw_w),
kw_rows AS (SELECT query_id, task_id, CAST(1 AS BIGINT) AS rewrite_no, r1 AS rewrite FROM kw WHERE r1 <> ''
            UNION ALL SELECT query_id, task_id, CAST(2 AS BIGINT), r2 FROM kw WHERE r2 <> '')"""


sql("keyword_rewrites", with_(UTURNS, keyword_rewrites_cte("upos")) + """
SELECT query_id, task_id, rewrite_no, rewrite FROM kw_rows""")


def topk_named(name: str, k: int, qid: str, qfilter: str = "TRUE") -> str:
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT {qid} AS query_id, c.task_id, c.vec_id, c.chunk_id, c.content,
           greatest(0.0, least(1.0, list_dot_product(q.vnn, c.vnn))) AS similarity_score,
           row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.vn, c.vn) DESC, c.vec_id) AS rk
    FROM renormed q JOIN renormed c ON q.task_id = c.task_id WHERE {qfilter})
  WHERE rk <= {k})"""


sql("corrective_merge", with_(VECTORS, NORMED, RENORMED, topk_cte(5), STRIPS,
                              topk_named("rw1", 5, "q.vec_id - 5", "q.vec_id >= 5"),
                              topk_named("rw2", 5, "q.vec_id - 10", "q.vec_id >= 10")) + """
, rws AS (SELECT query_id, chunk_id, 1 AS rewrite_no, rk AS rank FROM rw1
          UNION ALL SELECT query_id, chunk_id, 2, rk FROM rw2),
fresh AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY r.query_id, r.chunk_id ORDER BY rewrite_no, rank) AS x
                         FROM rws r WHERE NOT EXISTS (SELECT 1 FROM strips s WHERE s.query_id = r.query_id
                                                                                AND s.chunk_id = r.chunk_id))
          WHERE x = 1),
top AS (SELECT query_id, max(ord) AS t FROM strips GROUP BY query_id)
SELECT query_id, chunk_id, ord FROM strips
UNION ALL
SELECT f.query_id, f.chunk_id,
       CAST(coalesce(t.t, 0) + row_number() OVER (PARTITION BY f.query_id ORDER BY f.rewrite_no, f.rank) AS BIGINT)
FROM fresh f LEFT JOIN top t USING (query_id)""")

sql("select_strips", with_(*STRIP_BASE) + """
SELECT query_id, chunk_id, final_rank FROM (
  SELECT query_id, chunk_id,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY fgrade DESC, score DESC, ord) AS BIGINT) AS final_rank
  FROM strips) WHERE final_rank <= 5""")

sql("evidence_text", with_rec(VECTORS, NORMED, RENORMED, topk_cte(5), f2_cte(5, 0.2), GRADED_F2) + f"""
, ev AS (SELECT query_id, string_agg({evidence_line_expr()}, chr(10) ORDER BY rank) AS evidence FROM graded_f2 GROUP BY query_id),
l AS (SELECT query_id, rank, {evidence_line_expr()} AS line FROM graded_f2), {digest_cte("dg", "l", "rank")}
SELECT e.query_id, e.evidence, CAST(length(e.evidence) AS BIGINT) AS evidence_chars, length(e.evidence) > 2000 AS needs_digest,
       substring(e.evidence, 1, 2000) AS evidence_cut, d.evidence AS evidence_digest
FROM ev e JOIN dg d USING (query_id)""")

sql("answer_prompts", with_rec(*TEXT_HITS) + f"""
, lines AS (SELECT query_id, rank, {evidence_line_expr("h.")} AS line
            FROM (SELECT *, similarity_score AS score, CAST(NULL AS DOUBLE) AS grade FROM hits) h),
{digest_cte("ev", "lines", "rank")}
SELECT CAST(b.item_id AS BIGINT) AS query_id,
       'Retrieved evidence:' || chr(10) || chr(10) || coalesce(e.evidence, '') || chr(10) || chr(10)
       || 'User question:' || chr(10) || b.text || chr(10) AS prompt
FROM benchmark b LEFT JOIN ev e ON e.query_id = b.item_id""")

sql("chat_prompts", """
WITH h AS (
  SELECT conv_id, turn, role, text,
         list(struct_pack(turn := turn, role := coalesce(role, 'user'), text := coalesce(text, '')))
           OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS hist
  FROM conversations)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn,
       'You are a helpful and concise assistant. Answer naturally based on the ongoing conversation.' || chr(10)
       || 'Conversation so far:' || chr(10)
       || coalesce(array_to_string(list_transform(list_sort(hist), lambda m: m.role || ': ' || m.text), chr(10)), '')
       || chr(10) || chr(10) || 'User: ' || text || chr(10) || 'Assistant:' AS prompt
FROM h WHERE role = 'user'""")

# The transcript digest messages.
DIGEST_SYSTEM = """
You are a helpful assistant specialized in summarizing YouTube video transcripts that are generated by whisper model.
""".strip()
DIGEST_HEAD = """
Given the transcript of a YouTube video, your task is to generate a straight to point and informative summary.~

             The summary should cover key points, main ideas, and critical information, organized in a coherent and structured way.~

              Ensure that the summary is not exceed 1000 words.

             Make sure that the summary retains the flow and structure of the original transcript while omitting unnecessary details.~

              The summary should be easy to follow, informative, and structured, highlighting important tips, steps, or insights provided in the transcript.
            _

Transcript:  """.lstrip("\n").replace("~", " ").replace("_\n", "\n")

sql("digest_prompts", with_(TRANSCRIPTS) + f"""
SELECT task_id, '{DIGEST_SYSTEM}' AS system, '{DIGEST_HEAD}' || text || ' ' AS prompt FROM transcripts""")

sql("digest_prompts_evidence", with_rec(*TEXT_HITS) + f"""
, lines AS (SELECT query_id, rank, {evidence_line_expr("h.")} AS line
            FROM (SELECT *, similarity_score AS score, CAST(NULL AS DOUBLE) AS grade FROM hits) h),
ev AS (SELECT query_id, string_agg(line, chr(10) ORDER BY rank) AS evidence FROM lines GROUP BY query_id)
SELECT query_id, 'Summarize the following retrieved evidence into a concise digest that preserves key facts and names.'
       || chr(10) || 'Use bullet points where appropriate, keep it under 500 words.' || chr(10) || chr(10) || evidence AS prompt
FROM ev WHERE length(evidence) > 2000""")

sql("extractive_digest", with_(TRANSCRIPTS, SEGMENTS) + f"""
, words AS (SELECT task_id, seg_no, unnest(string_split_regex(lower(trim(text, {WS})), '\\s+')) AS w FROM segments),
ws AS (SELECT * FROM words WHERE w <> ''),
tf AS (SELECT task_id, w, count(*) AS tf FROM ws GROUP BY task_id, w),
dfq AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
nd AS (SELECT count(DISTINCT task_id) AS n FROM segments),
scored AS (SELECT ws.task_id, ws.seg_no, avg(tf.tf * ln(nd.n / dfq.df)) AS score, count(*) AS n_words
           FROM ws JOIN tf USING (task_id, w) JOIN dfq USING (w), nd GROUP BY ws.task_id, ws.seg_no),
picked AS (SELECT * FROM (SELECT *, sum(n_words) OVER (PARTITION BY task_id ORDER BY score DESC, seg_no
                                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
                          FROM scored) WHERE run <= 60)
, said AS (SELECT p.task_id, string_agg(s.text, ' ' ORDER BY s.seg_no) AS digest
          FROM picked p JOIN segments s USING (task_id, seg_no) GROUP BY p.task_id)
SELECT t.task_id, coalesce(s.digest, '') AS digest
FROM (SELECT DISTINCT task_id FROM segments) t LEFT JOIN said s USING (task_id)""")

sql("attach_completions", with_(UTURNS) + """
, comp AS (SELECT conv_id * 4294967296 + turn - 1 AS request_id, text FROM conversations WHERE role = 'assistant')
SELECT u.query_id AS request_id, coalesce(c.text, '') AS completion,
       CASE WHEN c.text IS NULL THEN 'missing completion' END AS completion_error
FROM upos u LEFT JOIN comp c ON c.request_id = u.query_id""")


def any_in_sql(msg: str, words) -> str:
    return "(" + " OR ".join(f"contains({msg}, '{w}')" for w in words) + ")"


ROUTE_TOPIC = ("video", "transcript", "dans la vidéo", "in the video", "speaker", "segment", "chunk",
               "ce que la vidéo dit", "what the video", "whisper", "youtube")
ROUTE_FACT = ("quel", "quelle", "combien", "when", "where", "who", "details", "exact")

sql("route_messages", f"""
WITH m AS (
  SELECT conv_id, turn, lower(coalesce(text, '')) AS msg, conv_id % 11 AS r,
         CASE WHEN conv_id % 11 IN (3, 4) THEN NULL ELSE 'all' END AS task_id
  FROM conversations WHERE role = 'user')
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn,
       CASE WHEN r = 0 THEN 'chat' WHEN r IN (1, 4) AND task_id IS NOT NULL THEN 'rag' WHEN r IN (1, 4) THEN 'chat'
            WHEN r = 2 THEN 'chat' WHEN task_id IS NULL THEN 'chat'
            WHEN {any_in_sql('msg', ROUTE_TOPIC)} THEN 'rag' WHEN {any_in_sql('msg', ROUTE_FACT)} THEN 'rag'
            ELSE 'chat' END AS mode,
       CASE WHEN r = 0 THEN 'chat_only toggle' WHEN r IN (1, 4) AND task_id IS NOT NULL THEN 'force_rag toggle'
            WHEN r IN (1, 4) THEN 'force_rag but no task selected' WHEN r = 2 THEN 'auto_retrieve disabled'
            WHEN task_id IS NULL THEN 'no task selected'
            WHEN {any_in_sql('msg', ROUTE_TOPIC)} THEN 'heuristic keywords matched'
            WHEN {any_in_sql('msg', ROUTE_FACT)} THEN 'factual signal' ELSE 'default chat' END AS reason
FROM m""")

sql("router_prompts", """
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn,
       CASE WHEN coalesce(text, '') = '' THEN NULL ELSE
       'Tu es un détecteur de type de question.' || chr(10) || 'Voici le message de l''utilisateur : "' || text || '"'
       || chr(10) || 'Réponds uniquement par ''RAG'' si la question demande une information externe,' || chr(10)
       || 'ou ''NORMAL'' si c''est une question simple de conversation.' || chr(10) END AS prompt
FROM conversations WHERE role = 'user'""")

sql("parse_route", f"""
WITH c AS (SELECT DISTINCT conv_id FROM conversations),
comp AS (SELECT conv_id AS request_id, CASE conv_id % 5 WHEN 0 THEN 'RAG' WHEN 1 THEN 'NORMAL' WHEN 2 THEN '`RAG`'
                                                        WHEN 3 THEN 'RAG or NORMAL' ELSE '' END AS text FROM c),
t AS (SELECT request_id, trim(trim(trim(text, {WS}), '`'), {WS}) AS raw FROM comp)
SELECT request_id,
       CASE WHEN contains(upper(raw), 'RAG') AND NOT contains(upper(raw), 'NORMAL') THEN 'rag'
            WHEN contains(upper(raw), 'NORMAL') AND NOT contains(upper(raw), 'RAG') THEN 'chat'
            WHEN string_split_regex(upper(raw), '\\s+')[1] = 'RAG' THEN 'rag' ELSE 'chat' END AS route_mode,
       raw AS route_raw
FROM t""")

sql("retrieval_report", with_(VECTORS, NORMED, RENORMED, topk_cte(20), f2_cte(20, 0.0), GRADED_F2) + """
SELECT query_id, CAST(rank AS BIGINT) AS rank,
       '  - r=' || CAST(rank AS VARCHAR) || ', sim=' || printf('%.2f', similarity_score)
       || ', grade=' || printf('%.2f', coalesce(grade, 0.0)) || ' faiss=' || printf('%.2f', index_similarity)
       || ', cl=' || coalesce(CAST(cluster_id AS VARCHAR), '-') || ' id=' || chunk_id AS report_line
FROM graded_f2 WHERE rank <= 10""")


# ---------------------------------------------------------------- corrective rounds, pipelines, streams, media
sql("corrective_rounds", with_rec(*TEXT_HITS) + f""",
first AS (SELECT h.query_id, h.chunk_id, h.content, CAST(h.rank AS BIGINT) AS ord, h.similarity_score AS score,
                 {lexical_grade_sql('b.text', 'h.content')} AS grade
          FROM hits h JOIN benchmark b ON b.item_id = h.query_id),
weak AS (SELECT query_id FROM first GROUP BY query_id HAVING max(grade) < 0.6),
wq AS (SELECT CAST(item_id AS BIGINT) AS query_id, 'all' AS task_id, text AS query FROM benchmark
       WHERE item_id IN (SELECT query_id FROM weak)),
{keyword_rewrites_cte('wq')},
""" + query_vecs_cte("rw_q", "(SELECT query_id * 10 + rewrite_no AS query_id, query_id AS parent_id, rewrite_no, task_id, "
                     "rewrite AS query FROM kw_rows)", "query_id, parent_id, rewrite_no, task_id") + "," + \
    search_cte("rw_hits", "rw_q", 5, 0.0, "q.query_id, q.parent_id, q.rewrite_no") + f""",
fresh AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY r.parent_id, r.chunk_id ORDER BY rewrite_no, rank) AS x
                         FROM rw_hits r WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.query_id = r.parent_id
                                                                                AND f.chunk_id = r.chunk_id))
          WHERE x = 1),
top AS (SELECT query_id, max(ord) AS t FROM first GROUP BY query_id),
merged AS (
  SELECT query_id, chunk_id, content, ord, score FROM first WHERE query_id IN (SELECT query_id FROM weak)
  UNION ALL
  SELECT f.parent_id, f.chunk_id, f.content,
         CAST(coalesce(t.t, 0) + row_number() OVER (PARTITION BY f.parent_id ORDER BY f.rewrite_no, f.rank) AS BIGINT),
         f.similarity_score
  FROM fresh f LEFT JOIN top t ON t.query_id = f.parent_id),
regraded AS (SELECT m.query_id, m.chunk_id, m.ord, m.score,
                    CASE WHEN m.ord <= 8 THEN {lexical_grade_sql('b.text', 'm.content')} ELSE 0.0 END AS grade
             FROM merged m JOIN benchmark b ON b.item_id = m.query_id)
SELECT query_id, chunk_id, ord, round(score, 6) AS score, round(grade, 6) AS grade FROM first
WHERE query_id NOT IN (SELECT query_id FROM weak)
UNION ALL
SELECT query_id, chunk_id, ord, round(score, 6), round(grade, 6) FROM regraded""")

sql("attach_vectors", with_rec(*CHUNK_CTES, tri_vectors_cte("cv", "chunks", "task_id, chunk_id", "content")) + """
SELECT task_id, chunk_id, vec FROM cv""")

sql("ingest", with_rec(*CHUNK_CTES, tri_vectors_cte("cv", "chunks", "task_id, chunk_id, chunk_index, character_count",
                                                    "content")) + """
SELECT task_id, chunk_id, CAST(chunk_index AS BIGINT) AS vec_id, character_count, vec FROM cv""")

sql("task_status", with_rec(*CHUNK_CTES) + """
, n AS (SELECT task_id, count(*) AS n FROM chunks GROUP BY task_id)
SELECT t.task_id, 'index' AS stage, CASE WHEN coalesce(n.n, 0) > 0 THEN 'completed' ELSE 'failed' END AS status,
       CASE WHEN coalesce(n.n, 0) > 0 THEN 'Hybrid index created successfully'
            ELSE 'Index creation failed: No embeddings provided to build the index' END AS message,
       CASE WHEN coalesce(n.n, 0) = 0 THEN 'No embeddings provided to build the index' END AS error,
       CAST(coalesce(n.n, 0) AS BIGINT) AS n_chunks
FROM transcripts t LEFT JOIN n USING (task_id)""")

INGEST_META = tri_vectors_cte("cv", "chunks", "task_id, chunk_index", "content") + """,
meta AS (SELECT task_id, CAST(count(*) AS BIGINT) AS n, count(DISTINCT CAST(vec AS VARCHAR)) AS d,
                CAST(max(len(vec)) AS BIGINT) AS dim FROM cv GROUP BY task_id),
meta2 AS (SELECT *, CASE WHEN n <= 5 THEN 'n_samples=' || CAST(n AS VARCHAR) || ' should be > n_clusters=5'
                         WHEN d < 2 THEN 'all points coincide' END AS cluster_error FROM meta)"""

sql("ingest_outcome", with_rec(*CHUNK_CTES, INGEST_META) + """
, sm AS (SELECT task_id, string_agg(substring(content, 1, 400) || '...', '' ORDER BY chunk_index) AS summary
         FROM chunks WHERE chunk_index < 3 GROUP BY task_id)
SELECT t.task_id, 'index' AS stage, CASE WHEN m.n > 0 THEN 'completed' ELSE 'failed' END AS status,
       CASE WHEN m.n > 0 THEN 'Hybrid index created successfully'
            ELSE 'Index creation failed: No embeddings provided to build the index' END AS message,
       CASE WHEN m.n IS NULL THEN 'No embeddings provided to build the index' END AS error,
       CAST(coalesce(m.n, 0) AS BIGINT) AS n_chunks, coalesce(m.n, 0) AS total_chunks,
       CASE WHEN m.n > 0 THEN 'hashed-trigram-64' END AS embedding_model, coalesce(m.dim, 0) AS embedding_dimension,
       m.cluster_error, coalesce(m.n, 0) > 0 AND m.cluster_error IS NULL AS clustered, s.summary
FROM transcripts t LEFT JOIN meta2 m USING (task_id) LEFT JOIN sm s USING (task_id)""")

ANSWER_PROMPT = """
'Retrieved evidence:' || chr(10) || chr(10) || coalesce(e.evidence, '') || chr(10) || chr(10)
|| 'User question:' || chr(10) || q.query || chr(10)"""

sql("answer_queries", with_rec(*CHUNK_CTES, CORPUS, *MEM_BASE, MERGED) + f"""
, lines AS (SELECT query_id, ord, {evidence_line_expr("h.")} AS line
            FROM (SELECT *, similarity_score AS score, CAST(NULL AS DOUBLE) AS grade FROM merged) h),
{digest_cte("ev", "lines", "ord")}
SELECT q.query_id, {ANSWER_PROMPT} AS prompt FROM upos q LEFT JOIN ev e USING (query_id)""")

def cut_grade(q: str, s: str) -> str:
    return f"floor({lexical_grade_sql(q, s)} * 100 + 1e-9) / 100"


def graded_ctes(questions: str) -> str:
    """From ``first`` (strips with their first grades) to ``best``: rewrites of weak questions, retrieved, merged, graded."""
    return f"""
weak AS (SELECT query_id FROM first GROUP BY query_id HAVING max(grade) < 0.6),
wq AS (SELECT query_id, 'all' AS task_id, query FROM {questions} WHERE query_id IN (SELECT query_id FROM weak)),
{keyword_rewrites_cte('wq')},
""" + query_vecs_cte("rw_q", "(SELECT query_id * 10 + rewrite_no AS query_id, query_id AS parent_id, rewrite_no, task_id, "
                     "rewrite AS query FROM kw_rows)", "query_id, parent_id, rewrite_no, task_id") + "," + \
        search_cte("rw_hits", "rw_q", 5, 0.0, "q.query_id, q.parent_id, q.rewrite_no") + f""",
fresh AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY r.parent_id, r.chunk_id ORDER BY rewrite_no, rank) AS x
                         FROM rw_hits r WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.query_id = r.parent_id
                                                                                AND f.chunk_id = r.chunk_id))
          WHERE x = 1),
top AS (SELECT query_id, max(ord) AS t FROM first GROUP BY query_id),
widened AS (
  SELECT query_id, chunk_id, content, cluster_id, ord, score FROM first WHERE query_id IN (SELECT query_id FROM weak)
  UNION ALL
  SELECT f.parent_id, f.chunk_id, f.content, f.cluster_id,
         CAST(coalesce(t.t, 0) + row_number() OVER (PARTITION BY f.parent_id ORDER BY f.rewrite_no, f.rank) AS BIGINT),
         f.similarity_score
  FROM fresh f LEFT JOIN top t ON t.query_id = f.parent_id),
graded AS (
  SELECT * FROM first WHERE query_id NOT IN (SELECT query_id FROM weak)
  UNION ALL
  SELECT m.query_id, m.chunk_id, m.content, m.cluster_id, m.ord, m.score,
         CASE WHEN m.ord <= 8 THEN {cut_grade('b.query', 'm.content')} ELSE 0.0 END
  FROM widened m JOIN {questions} b ON b.query_id = m.query_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, score DESC, ord) AS fr
                        FROM graded) WHERE fr <= 5),
lines AS (SELECT query_id, fr, {evidence_line_expr()} AS line FROM best),
{digest_cte("ev", "lines", "fr")}"""


sql("answer_graded", with_rec(*TEXT_HITS) + f""",
asked AS (SELECT CAST(item_id AS BIGINT) AS query_id, text AS query FROM benchmark),
first AS (SELECT h.query_id, h.chunk_id, h.content, h.cluster_id, CAST(h.rank AS BIGINT) AS ord, h.similarity_score AS score,
                 {cut_grade('b.query', 'h.content')} AS grade
          FROM hits h JOIN asked b USING (query_id)),
{graded_ctes('asked')}
SELECT q.query_id, {ANSWER_PROMPT} AS prompt FROM asked q LEFT JOIN ev e USING (query_id)""")

sql("answer_graded_memory", with_rec(*CHUNK_CTES, CORPUS, *MEM_BASE, MERGED) + f""",
first AS (SELECT h.query_id, h.chunk_id, h.content, h.cluster_id, CAST(h.ord AS BIGINT) AS ord, h.similarity_score AS score,
                 CASE WHEN h.ord <= 8 THEN {cut_grade('b.query', 'h.content')} ELSE 0.0 END AS grade
          FROM merged h JOIN upos b USING (query_id)),
{graded_ctes('upos')}
SELECT q.query_id, {ANSWER_PROMPT} AS prompt FROM upos q LEFT JOIN ev e USING (query_id)""")

ROUTED = f"""
routed AS (
  SELECT conv_id, turn, text, conv_id * 4294967296 + turn AS query_id, 'all' AS task_id, text AS query,
         CASE WHEN r = 0 THEN 'chat' WHEN r IN (1, 4) AND tid IS NOT NULL THEN 'rag' WHEN r IN (1, 4) THEN 'chat'
              WHEN r = 2 THEN 'chat' WHEN tid IS NULL THEN 'chat'
              WHEN {any_in_sql('msg', ROUTE_TOPIC)} THEN 'rag' WHEN {any_in_sql('msg', ROUTE_FACT)} THEN 'rag'
              ELSE 'chat' END AS mode,
         CASE WHEN r = 0 THEN 'chat_only toggle' WHEN r IN (1, 4) AND tid IS NOT NULL THEN 'force_rag toggle'
              WHEN r IN (1, 4) THEN 'force_rag but no task selected' WHEN r = 2 THEN 'auto_retrieve disabled'
              WHEN tid IS NULL THEN 'no task selected'
              WHEN {any_in_sql('msg', ROUTE_TOPIC)} THEN 'heuristic keywords matched'
              WHEN {any_in_sql('msg', ROUTE_FACT)} THEN 'factual signal' ELSE 'default chat' END AS reason
  FROM (SELECT *, lower(coalesce(text, '')) AS msg, conv_id % 11 AS r,
               CASE WHEN conv_id % 11 IN (3, 4) THEN NULL ELSE 'all' END AS tid
        FROM conversations WHERE role = 'user'))"""

CHAT_HIST = """
chat_p AS (
  SELECT conv_id, turn,
         'You are a helpful and concise assistant. Answer naturally based on the ongoing conversation.' || chr(10)
         || 'Conversation so far:' || chr(10)
         || coalesce(array_to_string(list_transform(list_sort(hist), lambda m: m.role || ': ' || m.text), chr(10)), '')
         || chr(10) || chr(10) || 'User: ' || text || chr(10) || 'Assistant:' AS prompt
  FROM (SELECT conv_id, turn, role, text,
               list(struct_pack(turn := turn, role := coalesce(role, 'user'), text := coalesce(text, '')))
                 OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS hist
        FROM conversations) WHERE role = 'user')"""

sql("chat_turns", with_rec(*CHUNK_CTES, CORPUS, ROUTED,
                           query_vecs_cte("rq", "(SELECT * FROM routed WHERE mode = 'rag')", "query_id, task_id, query"),
                           search_cte("rag_hits", "rq", 5, 0.0), CHAT_HIST) + f"""
, lines AS (SELECT query_id, rank, {evidence_line_expr("h.")} AS line
            FROM (SELECT *, similarity_score AS score, CAST(NULL AS DOUBLE) AS grade FROM rag_hits) h),
{digest_cte("ev", "lines", "rank")}
SELECT CAST(q.conv_id AS BIGINT) AS conv_id, CAST(q.turn AS BIGINT) AS turn, q.mode AS mode_used, q.reason,
       {ANSWER_PROMPT} AS prompt
FROM routed q LEFT JOIN ev e USING (query_id) WHERE q.mode = 'rag'
UNION ALL
SELECT CAST(r.conv_id AS BIGINT), CAST(r.turn AS BIGINT), r.mode, r.reason, c.prompt
FROM routed r LEFT JOIN chat_p c USING (conv_id, turn) WHERE r.mode = 'chat'""")

ROUTED_AUTO = f"""
routed AS (
  SELECT conv_id, turn, text, conv_id * 4294967296 + turn AS query_id, 'all' AS task_id, text AS query,
         CASE WHEN {any_in_sql('msg', ROUTE_TOPIC)} THEN 'rag' WHEN {any_in_sql('msg', ROUTE_FACT)} THEN 'rag'
              ELSE 'chat' END AS mode,
         CASE WHEN {any_in_sql('msg', ROUTE_TOPIC)} THEN 'heuristic keywords matched'
              WHEN {any_in_sql('msg', ROUTE_FACT)} THEN 'factual signal' ELSE 'default chat' END AS reason
  FROM (SELECT *, lower(coalesce(text, '')) AS msg FROM conversations WHERE role = 'user'))"""

RAG_TURNS = """
uturns AS (
  SELECT CAST(u.query_id AS BIGINT) AS query_id, 'all' AS task_id, 'all' AS memory_key, u.conv_id, u.turn, u.query,
         coalesce(a.text, '') AS answer
  FROM routed u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.mode = 'rag'),
upos AS (SELECT *, CAST(2 * (row_number() OVER (PARTITION BY memory_key ORDER BY conv_id, turn) - 1) AS BIGINT) AS pos
         FROM uturns)"""


def chat_memory_sql(routed: str) -> str:
    """Turns of J3 over one memory per task; also what the question stream writes in all its micro-batches."""
    return with_rec(*CHUNK_CTES, CORPUS, routed, memory_cte(RAG_TURNS), TURN_Q, CANDS, MERGED, CHAT_HIST) + f"""
, lines AS (SELECT query_id, ord, {evidence_line_expr("h.")} AS line
            FROM (SELECT *, similarity_score AS score, CAST(NULL AS DOUBLE) AS grade FROM merged) h),
{digest_cte("ev", "lines", "ord")}
SELECT CAST(q.conv_id AS BIGINT) AS conv_id, CAST(q.turn AS BIGINT) AS turn, q.mode AS mode_used, q.reason,
       {ANSWER_PROMPT} AS prompt
FROM routed q LEFT JOIN ev e USING (query_id) WHERE q.mode = 'rag'
UNION ALL
SELECT CAST(r.conv_id AS BIGINT), CAST(r.turn AS BIGINT), r.mode, r.reason, c.prompt
FROM routed r LEFT JOIN chat_p c USING (conv_id, turn) WHERE r.mode = 'chat'"""


sql("chat_turns_memory", chat_memory_sql(ROUTED))

sql("chat_memory_rows", with_(ROUTED, memory_cte(RAG_TURNS)) + """
SELECT memory_key, CAST(seq AS BIGINT) AS seq, type, text, vec FROM qa_vecs""")

sql("question_stream", chat_memory_sql(ROUTED_AUTO))

sql("ingest_stream", with_rec(*CHUNK_CTES, INGEST_META) + """
SELECT t.task_id, CASE WHEN m.n > 0 THEN 'completed' ELSE 'failed' END AS status, coalesce(m.n, 0) AS n_chunks,
       coalesce(m.n, 0) AS total_chunks,
       m.cluster_error
FROM transcripts t LEFT JOIN meta2 m USING (task_id)""")

sql("media_catalog", """
WITH p AS (SELECT page_id, html, coalesce(nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ''), 'Unknown Title') AS t
           FROM pages)
SELECT 'p' || CAST(page_id AS VARCHAR) AS task_id, regexp_replace(t, '[^A-Za-z0-9]+', '-', 'g') AS title,
       CAST(strlen(html) AS BIGINT) AS file_size
FROM p""")
