"""SQL (DuckDB) for the rows of the registered queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 80 * (na + nb - common) UNION SELECT b, a FROM pairs WHERE 100 * common >= 80 * (na + nb - common)),
reach AS (SELECT doc_id, doc_id AS r FROM sets UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT sets.doc_id, len(sets.s) AS n_shingles, min(reach.r) AS component_id FROM sets JOIN reach USING (doc_id) GROUP BY ALL"""

LINE_TEMPLATES = r"""
WITH lines AS (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
tokens AS (SELECT doc_id, text, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM lines),
leaves AS (SELECT *, len(ws) AS n, list_transform(ws[1:3], lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS lead FROM tokens WHERE len(ws) > 0),
held AS (SELECT DISTINCT doc_id, text, n, lead, ws FROM leaves),
distinct_lines AS (SELECT n, lead, ws, count(*) AS docs FROM held GROUP BY ALL),
live AS (SELECT n, lead FROM distinct_lines GROUP BY ALL HAVING sum(docs) >= 6),
placed AS (SELECT n, lead, ws, docs, generate_subscripts(ws, 1) AS place, unnest(ws) AS word FROM distinct_lines SEMI JOIN live USING (n, lead)),
support AS (SELECT n, lead, place, word FROM placed GROUP BY ALL HAVING sum(docs) >= 6),
shapes AS (SELECT n, lead, ws, list((place, word) ORDER BY place) AS fixed FROM placed SEMI JOIN support USING (n, lead, place, word) GROUP BY ALL HAVING count(*) >= 0.75 * n),
templates AS (SELECT n, lead, fixed, min(doc_id) AS first_id FROM (SELECT DISTINCT doc_id, text, n, lead, fixed FROM held JOIN shapes USING (n, lead, ws)) GROUP BY ALL HAVING count(*) >= 6),
gone AS (SELECT DISTINCT doc_id, text, pos FROM leaves JOIN shapes USING (n, lead, ws) JOIN templates USING (n, lead, fixed) WHERE doc_id <> first_id),
listed AS (SELECT doc_id, text, list(pos ORDER BY pos) AS dropped FROM gone GROUP BY ALL)
SELECT doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS INTEGER) AS n_lines, CAST(coalesce(len(dropped), 0) AS INTEGER) AS n_dropped, coalesce(array_to_string(dropped, ','), '') AS dropped_lines
FROM documents LEFT JOIN listed USING (doc_id, text)"""

NEIGHBOURS = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored QUALIFY rank <= 20"""
