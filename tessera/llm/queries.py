"""Registered queries of the subpackage, over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register("op5_source_mix")
def q_mix(spark, sf_dir):
    from tessera.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


@register("op6_histogram_shards")
def q_shards(spark, sf_dir):
    from tessera.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), columns=["doc_id"])


@register("op2_quality_rules")
def q_quality(spark, sf_dir):
    from tessera.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op4_pii_anchors")
def q_pii(spark, sf_dir):
    from tessera.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


@register("op9_trie_token_counts")
def q_token_counts(spark, sf_dir):
    from tessera.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


@register("op10_token_parquet")
def q_token_parquet(spark, sf_dir):
    from tessera.llm.token_output import token_digest

    return token_digest(table(spark, sf_dir, "documents"))


@register("op3_order_minhash")
def q_near_duplicates(spark, sf_dir):
    from tessera.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@register("op7_language_fusion")
def q_language(spark, sf_dir):
    from tessera.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


@register("page_languages")
def q_page_languages(spark, sf_dir):
    from tessera.llm.language import identify, page_fields

    return identify(page_fields(table(spark, sf_dir, "pages")), id_col="page_id", host_col="host", suffix_col="suffix")


OP8_SQL = r"""
WITH lowered AS (
  SELECT doc_id AS id, 0 AS side, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
  UNION ALL
  SELECT item_id, 1, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), words AS (
  SELECT id, side, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM lowered
), places AS (
  SELECT id, side, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5
), sh AS (
  SELECT DISTINCT id, side, array_to_string(w[i:i + 4], ' ') AS s FROM places
), sizes AS (
  SELECT id AS item, count(*) AS n FROM sh WHERE side = 1 GROUP BY id
), hits AS (
  SELECT d.id AS doc_id, b.id AS item, count(*) AS c
  FROM sh d JOIN sh b ON d.s = b.s AND d.side = 0 AND b.side = 1 GROUP BY d.id, b.id
), found AS (
  SELECT h.doc_id, h.item, h.c / CAST(z.n AS DOUBLE) AS containment FROM hits h JOIN sizes z ON z.item = h.item
  WHERE h.c / CAST(z.n AS DOUBLE) >= 0.8
), best AS (
  SELECT doc_id, item, containment, count(*) OVER (PARTITION BY doc_id) AS n_items,
         row_number() OVER (PARTITION BY doc_id ORDER BY containment DESC, item) AS r FROM found
)
SELECT d.doc_id, coalesce(b.n_items, 0) AS n_items, coalesce(b.item, -1) AS best_item, coalesce(b.containment, 0.0) AS containment,
       b.item IS NOT NULL AS contaminated
FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id AND b.r = 1
"""


@register("op8_containment_decontamination", OP8_SQL)
def q_decontamination(spark, sf_dir):
    from tessera.llm.decontam import contaminated_documents

    c = contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return c.fillna({"best_item": -1})


@register("op1_suffix_dedup")
def q_suffix_dedup(spark, sf_dir):
    from tessera.llm.suffix_dedup import deduplicated_texts

    return deduplicated_texts(table(spark, sf_dir, "documents")).drop("kept")


@register("op13_backtrack_bpe")
def q_backtrack_bpe(spark, sf_dir):
    from tessera.llm.backtrack_bpe import bpe_digest

    return bpe_digest(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE crc_bits AS (
  SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM crc_bits WHERE k = 8
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce('=' || source, '') AS tree,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         text,
         CASE WHEN xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
                                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 5 = 0
              THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS received
  FROM documents, crc_table
), hashed AS (
  SELECT rid, doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(received) || ':' || received, '-')) AS got
  FROM docs
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed
), nodes AS (
  SELECT tree, 0 AS lvl, pos, leaf AS d FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, pos // 16, sha256(string_agg(d, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM nodes) WHERE n > 1 GROUP BY tree, lvl, pos // 16
), heights AS (
  SELECT tree, max(lvl) AS h FROM nodes GROUP BY tree
), subroots AS (
  SELECT n.tree, n.d AS subroot, h, row_number() OVER (ORDER BY n.tree) - 1 AS pos
  FROM nodes n JOIN heights USING (tree) WHERE n.lvl = h
), tops AS (
  SELECT 0 AS lvl, pos, subroot AS d FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(d, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS n FROM tops) WHERE n > 1 GROUP BY lvl, pos // 16
), top_height AS (
  SELECT max(lvl) AS th FROM tops
), steps AS (
  SELECT l.rid, m.lvl AS k,
         coalesce(string_agg(m.d, '' ORDER BY m.pos) FILTER (m.pos < l.pos // (16 ** m.lvl)::BIGINT), '') AS pre,
         coalesce(string_agg(m.d, '' ORDER BY m.pos) FILTER (m.pos > l.pos // (16 ** m.lvl)::BIGINT), '') AS post
  FROM leaves l JOIN subroots s ON s.tree = l.tree
  JOIN nodes m ON m.tree = l.tree AND m.lvl < s.h AND m.pos // 16 = l.pos // (16 ** (m.lvl + 1))::BIGINT
  GROUP BY l.rid, m.lvl
  UNION ALL
  SELECT l.rid, 1000 + m.lvl,
         coalesce(string_agg(m.d, '' ORDER BY m.pos) FILTER (m.pos < s.pos // (16 ** m.lvl)::BIGINT), ''),
         coalesce(string_agg(m.d, '' ORDER BY m.pos) FILTER (m.pos > s.pos // (16 ** m.lvl)::BIGINT), '')
  FROM leaves l JOIN subroots s ON s.tree = l.tree CROSS JOIN top_height
  JOIN tops m ON m.lvl < th AND m.pos // 16 = s.pos // (16 ** (m.lvl + 1))::BIGINT
  GROUP BY l.rid, m.lvl
), proofs AS (
  SELECT rid, sha256(string_agg(pre || post, '' ORDER BY k)) AS proof, list(pre || '@' || post ORDER BY k) AS way FROM steps GROUP BY rid
), folded AS (
  SELECT l.doc_id, l.leaf, s.subroot, (SELECT d FROM tops, top_height WHERE lvl = th) AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
         list_reduce(coalesce(p.way, []), lambda f, w: sha256(replace(w, '@', f)), l.got) AS folded_root
  FROM leaves l JOIN subroots s ON s.tree = l.tree LEFT JOIN proofs p ON p.rid = l.rid
)
SELECT *, folded_root = root AS verified FROM folded
"""


@register("op12_merkle_manifest", OP12_SQL)
def q_merkle(spark, sf_dir):
    from tessera.llm.merkle import manifest_audit

    return manifest_audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), words AS (
  SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= 3
), counts AS (
  SELECT w.lang, w.source, w.term, CAST(count(*) AS HUGEINT) AS c FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term
  GROUP BY w.lang, w.source, w.term
), langs AS (
  SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang
), groups AS (
  SELECT d.lang, d.source, coalesce(max(l.v), 0) AS v, coalesce(max(l.n), 0) AS ln, coalesce(max(c.n), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM docs) d LEFT JOIN langs l ON l.lang = d.lang
  LEFT JOIN (SELECT lang, source, sum(c) AS n FROM counts GROUP BY lang, source) c ON c.lang = d.lang AND c.source = d.source
  GROUP BY d.lang, d.source
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (g.n + g.v) AS p,
         1 + (1000000000 * (k.total + 1)) // (g.ln + g.v) AS pl
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), found AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(p.value, 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - pl) * (p - pl)) // pl FROM shares WHERE c > 0 AND p > pl
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM found
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= 200
"""


@register("op11_source_divergence", OP11_SQL)
def q_divergence(spark, sf_dir):
    from tessera.llm.divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))
