"""DuckDB SQL of the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op8_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x) AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS win
  FROM (SELECT item_id, w, least(8, len(w)) AS k, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS j FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, ks WHERE len(w) >= k),
hit AS (
  SELECT p.doc_id, p.k, p.j, x.item_id
  FROM (SELECT doc_id, k, j, array_to_string(w[j:j + k - 1], ' ') AS win FROM pos) p JOIN win x USING (k, win)),
words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS i FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op6_neardup"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d),
c AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s) WHERE len(s) > 0 GROUP BY s),
x AS (SELECT rep, n, unnest(s) AS g FROM c),
p AS (
  SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(id, seen) AS (SELECT rep, rep FROM c UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a),
m AS (SELECT id, min(seen) AS comp FROM r GROUP BY id),
k AS (SELECT s.doc_id, len(s.s) AS n, coalesce(m.comp, s.doc_id) AS comp FROM s LEFT JOIN c ON c.s = list_sort(s.s) LEFT JOIN m ON m.id = c.rep)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, comp AS component_id, comp = doc_id AS kept FROM k
"""

SQL["op10_toolcalls"] = r"""
WITH u AS (SELECT * FROM conversations WHERE role = 'user'), a AS (SELECT * FROM conversations WHERE role = 'assistant')
SELECT u.conv_id, 'turn-' || u.turn AS call_id, u.turn, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS level,
  CAST(a.turn IS NOT NULL AS BIGINT) AS n_results, a.turn AS result_turn, true AS valid, '' AS errors,
  '{"arguments":{"prompt":' || CAST(to_json(u.text) AS VARCHAR) || '},"errors":[],"id":"turn-' || u.turn || '","level":0,"name":"reply","result":' ||
    CASE WHEN a.turn IS NULL THEN 'null' ELSE CAST(to_json(a.text) AS VARCHAR) END || ',"turn":' || u.turn || '}' AS json
FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
UNION ALL
SELECT a.conv_id, 'turn-' || (a.turn - 1), NULL, NULL, NULL, 1, a.turn, false, 'no call',
  '{"id":"turn-' || (a.turn - 1) || '","result":' || CAST(to_json(a.text) AS VARCHAR) || ',"turn":' || a.turn || '}'
FROM a ANTI JOIN u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
"""
