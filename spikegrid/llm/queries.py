"""Queries of this subpackage on the given tables, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spikegrid.llm import (
    conversations, hard_negatives, mixing, packing, pii, quality, sharding, simhash, suffix_dedup, token_files, url_filter, vector_search, warc,
)
from spikegrid.llm.common import documents, pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return register


@query()
def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS copy FROM d),
i AS (SELECT *, concat_ws('/', coalesce(CAST(doc_id AS VARCHAR), 'null'), copy, size, source) AS row_id FROM r),
s1 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM i GROUP BY source),
s2 AS (SELECT *, CAST(row_number() OVER (ORDER BY source NULLS LAST) AS BIGINT) AS no FROM s1),
s3 AS (SELECT *, CAST([5, 2, 1][(no - 1) % 3 + 1] AS BIGINT) AS w, source_size * 3 AS most FROM s2),
s4 AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
              CAST(coalesce(sum(most) OVER (ORDER BY most / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
              CAST(sum(w) OVER (ORDER BY most / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w_left FROM s3),
s5 AS (SELECT *, most * w_left <= (total - before) * w AS capped FROM s4),
s6 AS (SELECT *, CAST(coalesce(sum(most) FILTER (capped) OVER (), 0) AS BIGINT) AS taken_all, CAST(coalesce(sum(w) FILTER (NOT capped) OVER (), 1) AS BIGINT) AS rest FROM s5),
s AS (SELECT source, no, source_size, total, CASE WHEN capped THEN CAST(most AS DOUBLE) ELSE CAST(w * (total - taken_all) AS DOUBLE) / rest END AS target FROM s6),
b AS (SELECT greatest(1, (sum(size) + 131071) // 131072)::BIGINT AS block, sum(size)::BIGINT AS words FROM i),
starts AS (SELECT CAST(floor(coalesce(sum(target) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) * 4294967296 / sum(target) OVER ()) AS BIGINT) AS x, no FROM s WHERE target > 0),
points AS (SELECT k AS slot, (k * 2654435769) % 4294967296 AS x FROM (SELECT unnest(range(0, CAST((words + block - 1) // block AS BIGINT))) AS k FROM b)),
slots AS (SELECT slot, starts.no FROM points ASOF JOIN starts ON points.x >= starts.x),
ranked AS (SELECT no, slot, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS rank FROM slots),
docs AS (SELECT i.*, s.no, s.source_size, s.target, md5('0:' || i.row_id) AS h FROM i JOIN s ON i.source IS NOT DISTINCT FROM s.source),
stream AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY no ORDER BY h, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM docs WHERE size > 0),
rounds AS (SELECT row_id, no, size, pos + e * source_size AS start FROM stream, (SELECT unnest([0, 1, 2]) AS e) AS three),
pieces AS (SELECT row_id, no, size, start, unnest(range(start // block, (start + size - 1) // block + 1)) AS rank, block FROM rounds, b),
used AS (SELECT row_id, sum(least(start + size, (p.rank + 1) * block) - greatest(start, p.rank * block)) AS taken FROM pieces p JOIN ranked USING (no, rank) GROUP BY row_id)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM docs LEFT JOIN used USING (row_id)
"""


@query(MIX_SQL)
def op8_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir))


@query()
def op3_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(documents(spark, sf_dir))


@query()
def op6_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query()
def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@query()
def op4_ngram_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(pages(spark, sf_dir))


WARC_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""


@query(WARC_SQL)
def op7_loser_tree_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(pages(spark, sf_dir))


@query()
def op9_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query()
def op2_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(documents(spark, sf_dir))


@query()
def op5_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir))


@query()
def op11_checked_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(documents(spark, sf_dir))


NEGATIVES_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (
  SELECT a.row AS a_row, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.row <> b.row WHERE a.vec_id % 100 = 0),
p AS (
  SELECT a_row, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a_row ORDER BY score DESC, vec_id) AS no
  FROM s WHERE same QUALIFY no <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.a_row, p.no ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (a_row) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query(NEGATIVES_SQL)
def op13_threshold_algorithm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


CONVERSATIONS_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS name FROM conversations),
k AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(name) + 1), lambda p: [ascii(substring(name, p, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                            lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END), 4294967295) % 20 AS kind FROM c),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, (SELECT unnest([0, 1]) AS copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS no FROM d),
f AS (SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS trimmed, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY no) AS copy,
             left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY no) AS i_before FROM o),
g AS (SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN copy > 1 THEN 'duplicate' WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM f),
inserts(s, t, cost, edits, lines) AS (VALUES
  (0, 0, 0, '', ''), (0, 2, 3, 'I', chr(10) || 'user:'), (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 1, 0, '', ''), (1, 2, 3, 'I', chr(10) || 'user:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 2, 0, '', ''), (2, 3, 3, 'I', chr(10) || 'assistant:'), (3, 3, 0, '', ''), (3, 2, 3, 'I', chr(10) || 'user:')),
choices(t, edit, i, cost, role, next) AS (VALUES
  (0, 'K', 's', 0, NULL, 1), (0, 'K', 'u', 0, NULL, 2), (1, 'K', 'u', 0, NULL, 2), (2, 'K', 'a', 0, NULL, 3), (3, 'K', 'u', 0, NULL, 2),
  (0, 'R', NULL, 3, 'user', 2), (1, 'R', NULL, 3, 'user', 2), (2, 'R', NULL, 3, 'assistant', 3), (3, 'R', NULL, 3, 'user', 2),
  (0, 'D', NULL, 4, NULL, 0), (1, 'D', NULL, 4, NULL, 1), (2, 'D', NULL, 4, NULL, 2), (3, 'D', NULL, 4, NULL, 3)),
w(conv_id, no, s, best) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {'cost': CAST(0 AS BIGINT), 'edits': '', 'lines': ''} FROM g
  UNION ALL
  SELECT w.conv_id, g.no, c.next, min({'cost': w.best.cost + n.cost + c.cost + CASE WHEN c.edit <> 'D' AND g.fault = 'truncated' THEN 3 ELSE 0 END,
                                       'edits': w.best.edits || n.edits || c.edit,
                                       'lines': w.best.lines || n.lines || CASE WHEN c.edit = 'D' THEN '' ELSE chr(10) || coalesce(c.role, g.role) || ':' || g.text END})
  FROM w JOIN g ON w.conv_id IS NOT DISTINCT FROM g.conv_id AND g.no = w.no + 1 JOIN inserts n ON n.s = w.s
  JOIN choices c ON c.t = n.t AND (c.edit = 'D' OR g.fault NOT IN ('blank', 'duplicate')) AND (c.edit <> 'K' OR c.i = g.i)
  GROUP BY w.conv_id, g.no, c.next),
ended AS (
  SELECT w.conv_id, min({'cost': w.best.cost + n.cost, 'edits': w.best.edits || n.edits, 'lines': w.best.lines || n.lines}) AS best
  FROM w JOIN (SELECT conv_id, max(no) AS last FROM g GROUP BY conv_id) l ON w.conv_id IS NOT DISTINCT FROM l.conv_id AND w.no = l.last
  JOIN inserts n ON n.s = w.s AND n.t IN (0, 3) GROUP BY w.conv_id),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i_before IS NOT NULL AND i_before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(e.best.cost, 0) AS cost, coalesce(e.best.edits, '') AS audit, sha256(substring(coalesce(e.best.lines, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN sums s ON a.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN ended e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
"""


@query(CONVERSATIONS_SQL)
def op12_survivor_coalescence(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.audit(conversations.damaged(talks), talks)
