"""DuckDB counterparts, written from the definitions and sharing nothing with the operators."""

URL_FILTERS = r"""
WITH shots AS (
  SELECT row_number() OVER () AS rid, page_id,
    regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.+$', '') AS host,
    CASE WHEN regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/'
      ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END AS path,
    DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS day
  FROM pages),
hosts AS (SELECT DISTINCT host AS domain FROM shots WHERE host <> ''),
parents AS (SELECT DISTINCT array_to_string(string_split(domain, '.')[2:], '.') AS domain FROM hosts WHERE len(string_split(domain, '.')) > 2),
h AS (SELECT domain, CAST('0x' || substr(md5(domain), 1, 4) AS INTEGER) AS k FROM hosts),
p AS (SELECT domain, CAST('0x' || substr(md5(domain), 1, 4) AS INTEGER) AS k FROM parents),
open_close AS (
  SELECT 'spam' AS list, 'block' AS verdict, domain, '/' AS prefix, k % 300 AS a, k % 300 + 30 + k % 120 AS b FROM h WHERE k % 3 = 0
  -- The second addition ends at the removal only if that comes later.
  UNION ALL SELECT 'spam', 'block', domain, '/', k % 300 + 200, CASE WHEN 30 + k % 120 > 200 THEN k % 300 + 30 + k % 120 END FROM h WHERE k % 6 = 0
  UNION ALL SELECT 'mirrors', 'block', domain, '/fr', k % 100, NULL FROM h WHERE k % 5 = 0
  UNION ALL SELECT 'trusted', 'allow', domain, '/', k % 250, NULL FROM h WHERE k % 7 = 0
  UNION ALL SELECT 'adult', 'block', domain, '/', k % 200, k % 200 + 100 FROM p WHERE k % 4 = 0),
spans AS (SELECT list, verdict, domain, prefix, DATE '2024-01-01' + CAST(a AS INTEGER) AS start, DATE '2024-01-01' + CAST(b AS INTEGER) AS stop FROM open_close),
steps AS (SELECT rid, page_id, host, path, day, unnest(generate_series(1, len(string_split(host, '.')))) AS i FROM shots WHERE host <> ''),
met AS (
  SELECT s.rid, e.* FROM steps s JOIN spans e ON e.domain = array_to_string(string_split(s.host, '.')[s.i:], '.')
  WHERE e.start <= s.day AND (e.stop IS NULL OR s.day < e.stop) AND starts_with(s.path, e.prefix)),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length(domain) DESC, length(prefix) DESC, verdict DESC) AS n, count(*) OVER (PARTITION BY rid) AS n_open FROM met)
  WHERE n = 1),
named AS (
  SELECT m.rid, string_agg(DISTINCT m.list, ',' ORDER BY m.list) AS lists FROM met m JOIN best b ON m.rid = b.rid AND m.domain = b.domain AND m.prefix = b.prefix AND m.verdict = b.verdict GROUP BY m.rid)
SELECT s.page_id, s.host, s.day, coalesce(b.verdict, 'none') AS verdict, b.domain, b.prefix, n.lists, coalesce(b.n_open, 0) AS n_open
FROM shots s LEFT JOIN best b ON b.rid = s.rid LEFT JOIN named n ON n.rid = s.rid
"""

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS x FROM p),
b AS (
  SELECT page_id, payload_bytes,
    array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, 5 * (i // 4) + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest
  FROM d),
m AS (SELECT payload_digest, max(page_id) AS largest FROM b GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = largest THEN NULL ELSE largest END AS refers_to
FROM b JOIN m USING (payload_digest)
"""

NEAR_DEDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
half AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
link AS (SELECT x, y FROM half UNION SELECT y, x FROM half),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON link.x = reach.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""

LINE_QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce('a' || source, 'b') AS host FROM documents),
w AS (SELECT rid, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
grams AS (SELECT rid, i, ws[i : i + 2] AS g FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) > 2)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + j) AS n FROM again, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid),
texts AS (SELECT DISTINCT host, text, ls FROM w),
pieces AS (SELECT host, text, unnest(ls) AS x FROM texts),
lines AS (
  SELECT host, text, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words,
    array_to_string(regexp_extract_all(translate(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '123456789', '000000000'), '[^\x20\x09-\x0D]+'), ' ') AS line
  FROM pieces),
common AS (SELECT host, line FROM lines GROUP BY host, line HAVING count(DISTINCT text) > 20),
removed AS (SELECT host, text, sum(words) AS n FROM lines JOIN common USING (host, line) GROUP BY host, text),
counted AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(w.text, '[#*$%&|<>]')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(r.n, 0) AS removed_words
  FROM w LEFT JOIN covered c USING (rid) LEFT JOIN removed r ON r.host = w.host AND r.text = w.text),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(removed_words AS BIGINT) AS removed_words, base_failed, NOT base_failed AND n_words - removed_words >= 0.3 * n_words AS kept
FROM judged
"""

HARD_NEGATIVES = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

FILTER_AUDIT = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ 	-]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS lowest FROM t),
f AS (
  SELECT rid, doc_id, part, unnest(['A', 'B', 'C', 'D', 'E']) AS filter,
    unnest([len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text),
      regexp_matches(text, '[#$%&*|]'), coalesce(lowest < doc_id, false)]) AS fails
  FROM w),
fails AS (SELECT rid, filter FROM f WHERE fails),
orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || x FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
steps AS (SELECT o AS filter_order, CAST(i AS INTEGER) AS step, substr(o, i, 1) AS filter FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS i) WHERE length(o) = 5),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
docs AS (
  SELECT t.rid, t.part, coalesce(k.good, 0) AS good, coalesce(k.toxic, 0) AS toxic, coalesce(string_agg(x.filter, '' ORDER BY x.filter), '') AS failed
  FROM t LEFT JOIN known k ON k.doc_id = t.doc_id LEFT JOIN fails x ON x.rid = t.rid GROUP BY ALL),
kinds AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM docs GROUP BY part, failed),
played AS (
  SELECT k.*, s.*, contains(failed, s.filter) AS hit,
    len(list_filter([1, 2, 3, 4, 5], lambda i: i < s.step AND contains(failed, substr(s.filter_order, i, 1)))) > 0 AS gone
  FROM kinds k, steps s),
summed AS (
  SELECT part, filter_order, step, filter,
    sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = filter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND hit THEN toxic ELSE 0 END) AS toxic_lost
  FROM played GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM summed
"""
