"""DuckDB SQL for the operators that SQL can express."""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w"""

#: Every window of every item against every window of every document.
WINNOWING = f"""
WITH d AS (SELECT doc_id, {_WORDS} FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} FROM benchmark),
bi AS (SELECT item, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS win FROM bi),
di AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m),
h AS (SELECT doc_id, i, bw.m, item FROM (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS win FROM di) x JOIN bw ON bw.m = x.m AND bw.win = x.win),
n AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, range(13) t(j) WHERE j < m GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

#: Every 50-byte window, as hexadecimal digits, with the smallest document that has it.
REPEATED_STRINGS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM p),
f AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s),
g AS (SELECT DISTINCT w.doc_id, w.i FROM w JOIN f ON f.s = w.s WHERE f.low < w.doc_id),
n AS (SELECT doc_id, i, CASE WHEN i > lag(i, 1, -100) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM g),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY doc_id, run),
e AS (SELECT s.doc_id, a, z, coalesce(lead(a) OVER (PARTITION BY s.doc_id ORDER BY a), len(h) // 2) AS b, row_number() OVER (PARTITION BY s.doc_id ORDER BY a) AS k, h FROM s JOIN d ON d.doc_id = s.doc_id),
k AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans,
    string_agg(CASE WHEN k = 1 THEN substr(h, 1, CAST(2 * a AS BIGINT)) ELSE '' END || substr(h, CAST(2 * z + 1 AS BIGINT), CAST(2 * (b - z) AS BIGINT)), '' ORDER BY a) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
