"""The SQL of the queries that DuckDB can express."""

from __future__ import annotations

#: The words of a text, ASCII letters in lower case; a null has none.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

JACCARD_JOIN = f"""
WITH RECURSIVE docs AS (SELECT doc_id, md5(coalesce(text, '')) AS key, {WORDS} AS w FROM documents),
classes AS (SELECT key, min(doc_id) AS rep, count(*) AS copies, any_value(w) AS w FROM docs WHERE len(w) > 0 GROUP BY key),
places AS (SELECT key, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM classes),
shingles AS (SELECT DISTINCT key, array_to_string(w[k:k + 4], ' ') AS s FROM places),
sizes AS (SELECT key, count(*) AS n FROM shingles GROUP BY key),
common AS (SELECT x.key AS a, y.key AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.key <> y.key GROUP BY x.key, y.key),
links AS (SELECT a, b FROM common JOIN sizes x ON x.key = a JOIN sizes y ON y.key = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach AS (SELECT key, key AS other FROM classes UNION SELECT reach.key, links.b FROM reach JOIN links ON reach.other = links.a),
least AS (SELECT reach.key, min(rep) AS class_id FROM reach JOIN classes ON classes.key = other GROUP BY reach.key),
linked AS (SELECT a AS key, sum(copies) AS n FROM links JOIN classes ON classes.key = b GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id,
    CAST(coalesce(copies, 1) - 1 + coalesce(n, 0) AS BIGINT) AS n_links, CAST(coalesce(copies, 1) AS BIGINT) AS copies
FROM docs LEFT JOIN classes USING (key) LEFT JOIN least USING (key) LEFT JOIN linked USING (key)
"""

DECONTAMINATION = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS} AS w FROM benchmark),
starts AS (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM starts),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, lengths WHERE len(w) >= n),
hits AS (SELECT r, k, n, item FROM (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM places) JOIN windows USING (n, g)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""
