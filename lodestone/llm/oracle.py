"""DuckDB SQL for the contract queries whose whole result SQL can express, over whole tables.

The SQL states the contracts plainly and shares no method with the operators.
The others hold what a model learned, a dynamic program chose or a parser read.
"""

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SUFFIX_DEDUP = """
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
place AS (SELECT r, doc_id, h, unnest(range(0, n - 49)) AS p FROM doc WHERE n >= 50 AND doc_id IS NOT NULL),
win AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS v FROM place),
shared AS (SELECT v, min(doc_id) AS least FROM win GROUP BY v HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT win.r, win.p FROM win JOIN shared USING (v) WHERE shared.least < win.doc_id),
edge AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM gone),
run AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS s FROM edge),
span AS (SELECT r, s, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY r, s),
gap AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM span),
cut AS (
  SELECT g.r, count(*) AS n_spans, sum(g.b - g.a) AS n_removed, max(g.b) AS last,
    string_agg(substr(doc.h, 2 * g.before + 1, 2 * (g.a - g.before)), '' ORDER BY g.a) AS head
  FROM gap g JOIN doc USING (r) GROUP BY g.r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM doc LEFT JOIN cut USING (r)
"""

DECONTAMINATION = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
item AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
start AS (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, list_slice(w, i, i + k - 1) AS v FROM start),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM doc),
ahead AS (SELECT r, i, list(x) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS v FROM word),
size AS (SELECT DISTINCT k FROM win),
asked AS (SELECT r, i, k, list_slice(v, 1, k) AS v FROM ahead, size WHERE len(v) >= k),
found AS (SELECT asked.r, asked.i, asked.k, win.item FROM asked JOIN win ON asked.k = win.k AND asked.v = win.v),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS place FROM found) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS joined FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

VECTOR_DUP = """
WITH RECURSIVE vec AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e,
    embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS sound
  FROM embeddings),
unit AS (SELECT r, vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM vec WHERE sound),
link AS (SELECT a.r AS a, b.r AS b, b.vec_id AS other FROM unit a JOIN unit b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.95),
reach AS (SELECT a, b, other FROM link UNION SELECT reach.a, link.b, link.other FROM reach JOIN link ON reach.b = link.a),
component AS (SELECT a, min(other) AS least FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(coalesce(component.least, vec_id), vec_id) AS component_id, least(coalesce(component.least, vec_id), vec_id) = vec_id AS kept
FROM vec LEFT JOIN degree ON degree.a = vec.r LEFT JOIN component ON component.a = vec.r
"""

ORACLE_SQL = {"op2_suffix_dedup": SUFFIX_DEDUP, "op3_vector_dup": VECTOR_DUP, "op5_decontamination": DECONTAMINATION}
