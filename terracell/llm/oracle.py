"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents
), windows AS (
  SELECT r, unnest(range(0, len(w) - 7)) AS p, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS k
  FROM d WHERE len(w) >= 8
), twice AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, k) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, p + o.o AS q FROM twice, (SELECT unnest(range(0, 8)) AS o) o) GROUP BY r
), f AS (
  SELECT d.r, doc_id, source, cast(len(w) AS BIGINT) AS n_words, cast(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    cast(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    cast(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN repeats ON d.r = repeats.r
), j AS (
  SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repetitive FROM f
), hosts AS (
  SELECT source, count(*) AS n, sum(short::INT) AS x1, sum(repetitive::INT) AS x2 FROM j WHERE source IS NOT NULL GROUP BY source
), sums AS (
  SELECT sum(n) AS n, count(*) AS hosts, sum(x1) / sum(n) AS m1, sum(x2) / sum(n) AS m2,
    sum(x1 * x1 / n) / sum(n) AS s1, sum(x2 * x2 / n) / sum(n) AS s2 FROM hosts
), between_hosts AS (
  SELECT *, s1 - m1 * m1 - m1 * (1 - m1) * hosts / n AS b1, s2 - m2 * m2 - m2 * (1 - m2) * hosts / n AS b2 FROM sums
), prior AS (
  SELECT m1, m2,
    CASE WHEN b1 > 1e-12 THEN least(greatest(m1 * (1 - m1) / b1 - 1, 1.0), 1e6) ELSE 1e6 END AS k1,
    CASE WHEN b2 > 1e-12 THEN least(greatest(m2 * (1 - m2) / b2 - 1, 1.0), 1e6) ELSE 1e6 END AS k2 FROM between_hosts
), bad AS (
  SELECT source FROM hosts, prior WHERE greatest((x1 + m1 * k1) / (hosts.n + k1), (x2 + m2 * k2) / (hosts.n + k2)) >= 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed,
  NOT (short OR repetitive) AND bad.source IS NULL AS kept
FROM j LEFT JOIN bad ON j.source = bad.source
"""

OP8 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(role, '\', '\b'), '<', '\l'), '"', '\q') AS r, replace(replace(replace(text, '\', '\b'), '<', '\l'), '"', '\q') AS x FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, x)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, x) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(22 + length(r) + length(x)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP2 = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, cast(embedding AS DOUBLE[]) AS e FROM embeddings
), sound AS (
  SELECT r, vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v
  WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.r AS x, b.r AS y FROM sound a JOIN sound b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.95
), counts AS (
  SELECT x AS r, count(*) AS n FROM links GROUP BY x
), reach(r, c) AS (
  SELECT r, vec_id FROM v WHERE vec_id IS NOT NULL UNION SELECT links.y, reach.c FROM reach JOIN links ON links.x = reach.r
), least AS (
  SELECT r, min(c) AS c FROM reach GROUP BY r
)
SELECT vec_id, CASE WHEN vec_id IS NOT NULL THEN cast(coalesce(n, 0) AS BIGINT) END AS n_links, c AS component_id, vec_id = c AS kept
FROM v LEFT JOIN counts ON v.r = counts.r LEFT JOIN least ON v.r = least.r
"""

OP3 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT r, k FROM (
    SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS k FROM d)
), sizes AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), common AS (
  SELECT a.r AS x, b.r AS y, count(*) AS n FROM s a JOIN s b ON a.k = b.k AND a.r <> b.r GROUP BY a.r, b.r
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.r = x JOIN sizes q ON q.r = y JOIN d i ON i.r = x JOIN d j ON j.r = y
  WHERE 100 * common.n >= 85 * (p.n + q.n - common.n) AND i.doc_id IS NOT NULL AND j.doc_id IS NOT NULL
), reach(r, c) AS (
  SELECT r, doc_id FROM d UNION SELECT links.y, reach.c FROM reach JOIN links ON links.x = reach.r
), least AS (
  SELECT r, min(c) AS c FROM reach GROUP BY r
)
SELECT doc_id, cast(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id FROM d LEFT JOIN sizes ON d.r = sizes.r LEFT JOIN least ON d.r = least.r
"""

ORACLE_SQL = {"op2_embedding_near_dedup": OP2, "op3_jaccard_join": OP3, "op4_quality_rules": OP4, "op8_chat_format": OP8}
