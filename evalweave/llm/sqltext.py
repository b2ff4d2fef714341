"""DuckDB SQL for the operators that SQL can express."""

MIXING = """
WITH unit AS (
  SELECT source, doc_id, greatest(CAST(floor(sqrt(CAST(greatest(coalesce(n_chars, 0), 0) AS DOUBLE)) * 16.0) AS BIGINT), 1) AS z FROM documents),
per AS (SELECT source, count(*) AS n, CAST(sum(z) AS BIGINT) AS zs, CAST(floor(sqrt(CAST(count(*) AS DOUBLE)) * 1048576.0) AS BIGINT) AS r FROM unit GROUP BY source),
everything AS (SELECT CAST(sum(n) AS BIGINT) AS m, CAST(sum(r) AS BIGINT) AS rs FROM per),
goal AS (SELECT source, zs, CAST(floor(CAST(m AS DOUBLE) * CAST(r AS DOUBLE) / CAST(rs AS DOUBLE) + 0.5::DOUBLE) AS BIGINT) AS want FROM per, everything),
odds AS (
  SELECT u.source, u.doc_id, g.want, CAST(g.want AS DOUBLE) * CAST(u.z AS DOUBLE) / CAST(g.zs AS DOUBLE) AS expected,
    (CAST(('0x' || substr(md5(coalesce(CAST(u.doc_id AS VARCHAR), 'null') || '|mix'), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM unit u JOIN goal g ON u.source IS NOT DISTINCT FROM g.source),
whole AS (SELECT *, CAST(floor(expected) AS BIGINT) AS copies, expected - floor(expected) AS p FROM odds),
ranked AS (
  SELECT *, want - CAST(sum(copies) OVER (PARTITION BY source) AS BIGINT) AS rest,
    rank() OVER (PARTITION BY source ORDER BY CASE WHEN p > 0 THEN 0 ELSE 1 END, u * (1.0::DOUBLE - p) / (u * (1.0::DOUBLE - p) + (1.0::DOUBLE - u) * p), doc_id NULLS FIRST) AS place
  FROM whole)
SELECT doc_id, source, copies + CASE WHEN p > 0 AND place <= rest THEN 1 ELSE 0 END AS copies
FROM ranked WHERE copies + CASE WHEN p > 0 AND place <= rest THEN 1 ELSE 0 END > 0
"""

SUFFIX = """
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') AS w FROM documents),
grams AS (SELECT doc_id, i, hash(list_slice(w, i + 1, i + 50)) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM words WHERE len(w) >= 50)),
placed AS (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) = 1 AS keep FROM grams),
marked AS (SELECT doc_id, keep, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id, keep ORDER BY i) + 50 THEN 1 ELSE 0 END AS s FROM placed WHERE c > 1),
islands AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, keep ORDER BY i) AS island FROM marked)
SELECT doc_id, min(i) AS start_word, max(i) + 50 AS end_word, keep FROM islands GROUP BY doc_id, keep, island
"""

TOPK = """
WITH unit AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))) * 16777216.0::DOUBLE + 0.5::DOUBLE)) AS v FROM embeddings),
pairs AS (SELECT a.vec_id, b.vec_id AS neighbour_id, list_dot_product(a.v, b.v) / 281474976710656.0::DOUBLE AS score FROM unit a JOIN unit b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour_id) AS place FROM pairs)
SELECT vec_id, neighbour_id, place, score FROM ranked WHERE place <= 10
"""

JACCARD = """
WITH RECURSIVE texts AS (SELECT text, row_number() OVER (ORDER BY text) AS e FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY text),
words AS (SELECT e, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') AS w FROM texts),
grams AS (SELECT DISTINCT e, unnest(CASE len(w) WHEN 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS gram FROM words WHERE len(w) > 0),
sizes AS (SELECT e, count(*) AS n FROM grams GROUP BY e),
pairs AS (SELECT a.e AS x, b.e AS y, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.e < b.e GROUP BY ALL),
near AS (SELECT x, y FROM pairs JOIN sizes p ON p.e = x JOIN sizes q ON q.e = y WHERE c >= 0.7::DOUBLE * (p.n + q.n - c) - 1e-9::DOUBLE),
alike AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near UNION ALL SELECT e, e FROM sizes),
members AS (SELECT DISTINCT doc_id, e FROM documents JOIN texts USING (text) JOIN sizes USING (e) WHERE doc_id IS NOT NULL),
found AS (SELECT a.doc_id, b.doc_id AS other, a.e = b.e AND a.doc_id = b.doc_id AS itself FROM members a JOIN alike ON a.e = x JOIN members b ON b.e = y),
edges AS (SELECT DISTINCT doc_id, other FROM found WHERE doc_id <> other),
reached AS (SELECT DISTINCT doc_id AS root, doc_id FROM documents WHERE doc_id IS NOT NULL UNION SELECT root, other FROM reached JOIN edges USING (doc_id) WHERE other > root),
totals AS (SELECT doc_id, count(*) FILTER (WHERE NOT itself) AS links FROM found GROUP BY doc_id)
SELECT r.doc_id, min(r.root) AS class_id, CAST(coalesce(any_value(t.links), 0) AS BIGINT) AS links FROM reached r LEFT JOIN totals t ON t.doc_id = r.doc_id GROUP BY r.doc_id
"""
