"""DuckDB counterparts of near-duplicates and repeats, by plain joins over all shingles and all windows."""

from __future__ import annotations

OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')] ELSE list_distinct(list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i : i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
u AS MATERIALIZED (SELECT doc_id, unnest(sh) AS g FROM s),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT DISTINCT x AS v, x AS r FROM both_ways UNION SELECT reach.v, y FROM reach JOIN both_ways ON x = r),
c AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)
SELECT n.doc_id, n.n AS n_shingles, coalesce(c.component_id, n.doc_id) AS component_id, coalesce(c.component_id, n.doc_id) = n.doc_id AS kept FROM n LEFT JOIN c ON c.v = n.doc_id
"""

OP6_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, p, md5(array_slice(b, p, p + 99)) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 98)) AS p FROM d WHERE n >= 100)),
later AS MATERIALIZED (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
marked AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, (p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, 0))::INTEGER AS fresh FROM later)),
runs AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS e FROM marked GROUP BY doc_id, run),
sums AS (SELECT doc_id, sum(e - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM runs GROUP BY doc_id),
cuts AS (SELECT doc_id, a AS till, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 1) AS since FROM (SELECT doc_id, a, e FROM runs UNION ALL SELECT doc_id, n + 1, n + 2 FROM d)),
kept AS (SELECT c.doc_id, string_agg(CASE WHEN till > since THEN hex(array_slice(b, since, till - 1)) ELSE '' END, '' ORDER BY since, till) AS x FROM cuts c JOIN d USING (doc_id) GROUP BY c.doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(x)) AS kept_sha256 FROM d LEFT JOIN sums USING (doc_id) JOIN kept USING (doc_id)
"""
