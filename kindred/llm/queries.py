"""Queries over the driver's tables, one for each numbered operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, exact, fim, licenses, minhash, quality_fm, quality_rules, substring, suffix_lm, trie, urlfilter, warc


#: Rows of an Arrow batch: texts are long, and both sides of the pipe hold whole batches.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_digest(table(spark, sf_dir, "pages"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_digest(table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), urlfilter.rules_table(spark))


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.suffix_tree_scores(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_digest(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_digest(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_minhash, op3_bpe, op4_quality, op5_licenses, op6_substring, op7_urls, op8_suffix_tree, op9_decontaminate, op10_quality_rules, op11_fill_in_middle, op12_prefix_trie, op13_exact_dedup)}


_SQL_1 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes::BIGINT AS payload_bytes, p.payload_digest,
       CASE WHEN f.first_id < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id < p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest
"""

_SQL_7 = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u
), r(r_host, r_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT p.page_id, max(struct_pack(n := length(r_host || r_path), rule := r_host || r_path, verdict := verdict)) AS best
  FROM p JOIN r ON ('.' || p.host) LIKE ('%.' || r_host) AND starts_with(p.path, r_path) GROUP BY p.page_id
)
SELECT p.page_id, coalesce(p.host, '') AS host, coalesce(p.path, '') AS path, m.best.rule AS rule, coalesce(m.best.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.page_id = p.page_id
"""

_SQL_10 = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, lang, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1
), cover AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, len(list_distinct(w))::BIGINT AS n_distinct,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(t, '[^!-/:-@\[-`{-~]+', '', 'g'))::BIGINT AS n_marks,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cover ON cover.doc_id = w.doc_id
), base AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), v AS (
  SELECT doc_id, lang, source, unnest([
    {'measure': 'marks', 'v': 10000 * n_marks // word_chars},
    {'measure': 'sameness', 'v': CASE WHEN n_words > 1 THEN 10000 - floor(10000 * ln(n_distinct) / ln(n_words) + 1e-6)::BIGINT ELSE 0 END},
    {'measure': 'word_length', 'v': 1000 * word_chars // n_words}], recursive := true)
  FROM base WHERE n_words > 0
), b AS (
  SELECT *, CASE WHEN v < 128 THEN v ELSE (length(bin(v)) - 7) * 64 + (v >> (length(bin(v)) - 7)::BIGINT) END AS b FROM v
), own AS (
  SELECT lang, source, measure, b, count(*) AS n FROM b GROUP BY ALL
), three AS (
  SELECT 1 AS lvl, lang, source, measure, b, n FROM own
  UNION ALL SELECT 2, lang, NULL, measure, b, sum(n) FROM own GROUP BY lang, measure, b
  UNION ALL SELECT 3, NULL, NULL, measure, b, sum(n) FROM own GROUP BY measure, b
), acc AS (
  SELECT *, sum(n) OVER (PARTITION BY lvl, lang, source, measure ORDER BY b) AS c, sum(n) OVER (PARTITION BY lvl, lang, source, measure) AS total,
         CASE WHEN b < 128 THEN 1 ELSE 1::BIGINT << (b // 64 - 1)::BIGINT END AS width, CASE WHEN b < 128 THEN b ELSE (b % 64 + 65) * width - 1 END AS edge FROM three
), q AS (
  SELECT lvl, lang, source, measure, any_value(total) AS total, min(edge) FILTER (c * 4 >= total) AS q1, min(edge) FILTER (c * 4 >= total * 3) AS q3,
         min(width) FILTER (c * 4 >= total * 3) AS width
  FROM acc GROUP BY lvl, lang, source, measure
), s AS (
  SELECT lvl, lang, source, measure, total, {'low': q1 - 4 * greatest(q3 - q1, width), 'high': q3 + 4 * greatest(q3 - q1, width)} AS f FROM q
), used AS (
  SELECT o.lang, o.source, o.measure, CASE WHEN o.total >= 50 THEN o.f WHEN l.total >= 50 THEN l.f ELSE a.f END AS f
  FROM s o JOIN s l ON l.lvl = 2 AND l.lang IS NOT DISTINCT FROM o.lang AND l.measure = o.measure JOIN s a ON a.lvl = 3 AND a.measure = o.measure
  WHERE o.lvl = 1
), out AS (
  SELECT b.doc_id, bool_or(b.v > u.f.high OR b.measure = 'word_length' AND b.v < u.f.low) AS outside
  FROM b JOIN used u ON u.lang IS NOT DISTINCT FROM b.lang AND u.source IS NOT DISTINCT FROM b.source AND u.measure = b.measure GROUP BY b.doc_id
)
SELECT base.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(outside, false) AS kept
FROM base LEFT JOIN out ON out.doc_id = base.doc_id
"""


_SQL_11 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
), l AS (
  SELECT *, string_split(t, chr(10)) AS s FROM d
), c AS (
  SELECT *, CASE WHEN t = '' THEN 0 ELSE len(s) - (s[len(s)] = '')::BIGINT END AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM l
), e AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR strpos(t, '<P>') > 0 OR strpos(t, '<S>') > 0 OR strpos(t, '<M>') > 0 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c
), f AS (
  SELECT *, array_to_string(s[1:a], chr(10)) || CASE WHEN a > 0 AND a < len(s) THEN chr(10) ELSE '' END AS head, array_to_string(s[1:b], chr(10)) || CASE WHEN b > 0 AND b < len(s) THEN chr(10) ELSE '' END AS most FROM e
), g AS (
  SELECT *, substr(most, length(head) + 1) AS middle, substr(t, length(most) + 1) AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(head) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || head || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || head || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM g
"""

_SQL_12 = r"""
WITH t AS (
  SELECT conv_id, x, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, x) AS i FROM (
    SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL
  )
), c AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda y: [ord(y)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
    lambda y, z: xor(xor(y, z) >> 1, (xor(y, z) & 1) * 3988292384))) % 4 AS h FROM t
), r AS (
  SELECT c.conv_id, 0 AS part, i, x, w FROM c JOIN t ON t.conv_id = c.base AND i <= h UNION ALL SELECT c.conv_id, 1, i, x, w FROM c JOIN t ON t.conv_id = c.conv_id AND i > h
), s AS (
  SELECT conv_id, w, row_number() OVER o AS depth, string_agg(x, '') OVER (o ROWS UNBOUNDED PRECEDING) AS p FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY part, i)
), q AS (
  SELECT conv_id, depth, sha256(p) AS p, lag(sha256(p), 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS above, w, lead(depth) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS is_end FROM s
  UNION ALL SELECT c.conv_id, 0, '', NULL, 0, NOT EXISTS (SELECT 1 FROM s WHERE s.conv_id = c.conv_id) FROM c
), n AS (
  SELECT p, depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256 FROM q GROUP BY p, depth
), k AS (
  SELECT above, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY above, depth
), u AS (
  SELECT q.p, q.depth, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum(n.own)::BIGINT AS saved_tokens
  FROM n JOIN q ON q.conv_id = n.conv_id AND q.depth <= n.depth LEFT JOIN k ON k.above = n.p AND k.depth = n.depth GROUP BY q.p, q.depth
)
SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, u.n_leaves, u.saved_tokens, n.ends_sha256
FROM n JOIN u ON u.p = n.p AND u.depth = n.depth LEFT JOIN k ON k.above = n.p AND k.depth = n.depth LEFT JOIN n a ON a.p = n.above AND a.depth = n.depth - 1
"""

_SQL_13 = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON g.t = d.t
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": _SQL_1, "op7_urls": _SQL_7, "op10_quality_rules": _SQL_10, "op11_fill_in_middle": _SQL_11, "op12_prefix_trie": _SQL_12, "op13_exact_dedup": _SQL_13}
