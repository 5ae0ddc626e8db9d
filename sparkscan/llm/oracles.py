"""DuckDB SQL for the rows of those queries that SQL can express."""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
k AS MATERIALIZED (SELECT doc_id, min(doc_id) OVER (PARTITION BY g) AS holder FROM (SELECT doc_id, string_agg(g, chr(10) ORDER BY g) AS g FROM s GROUP BY doc_id)),
m AS (SELECT x, count(DISTINCT b.holder) AS n_links FROM e JOIN k a ON a.doc_id = x JOIN k b ON b.doc_id = y WHERE a.holder <> b.holder GROUP BY x)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.x = w.doc_id LEFT JOIN m ON m.x = w.doc_id"""

OP3 = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
h AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
f AS (SELECT s, min(doc_id) AS d FROM h GROUP BY s),
c AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM h JOIN f USING (s) WHERE d < doc_id),
r AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id),
q AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM w) ANTI JOIN c USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id) LEFT JOIN q USING (doc_id)"""

OP8 = """
WITH l AS MATERIALIZED (SELECT doc_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
t AS MATERIALIZED (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS d FROM t WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
m AS (SELECT t.*, coalesce(t.doc_id > f.d, false) AS gone FROM t LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""
