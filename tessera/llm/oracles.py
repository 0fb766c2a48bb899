"""DuckDB SQL of the queries that SQL can express."""

OP3 = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
d AS (SELECT k FROM g GROUP BY k HAVING count(*) > 1),
c AS (SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM g WHERE k IN (SELECT k FROM d)) GROUP BY r)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(ps, j)) END, ' ')) AS kept_sha256 FROM w LEFT JOIN c ON w.r = c.r
"""

OP6 = r"""
WITH t AS (SELECT doc_id, text, row_number() OVER () AS r, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i - 1 AS no, doc_id::HUGEINT * 4294967296 + i - 1 AS ord, list_filter(regexp_split_to_array(lower(ls[i]), '[ \x09-\x0D]+'), lambda x: x <> '') AS ws FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM t)),
o AS (SELECT r, no, ord, ws, array_to_string(ws, ' ') AS s FROM l WHERE len(ws) > 0 AND doc_id IS NOT NULL),
d AS (SELECT s, min(ord) AS ord, len(any_value(ws)) AS n, any_value(ws) AS ws FROM o GROUP BY s),
v AS (SELECT ord, n, i, array_to_string(list_concat(ws[1:i - 1], ws[i + 1:n]), ' ') AS v FROM (SELECT ord, n, ws, unnest(range(1, n + 1)) AS i FROM d WHERE n >= 6)),
sub AS (SELECT v.ord FROM v JOIN (SELECT v, i, n, min(ord) AS lo FROM v GROUP BY v, i, n HAVING count(*) > 1) g ON v.v = g.v AND v.i = g.i AND v.n = g.n AND v.ord > g.lo),
ins AS (SELECT greatest(v.ord, d.ord) AS ord FROM v JOIN d ON v.v = d.s AND v.n = d.n + 1 AND d.n >= 6 AND v.ord <> d.ord),
gone AS (SELECT DISTINCT o.r, o.no FROM o JOIN d ON o.s = d.s WHERE o.ord > d.ord OR d.ord IN (SELECT ord FROM sub UNION SELECT ord FROM ins)),
g AS (SELECT r, list(no) AS nos FROM gone GROUP BY r)
SELECT t.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(nos), 0)::BIGINT AS n_removed, CASE WHEN text IS NOT NULL THEN array_to_string(CASE WHEN nos IS NULL THEN ls ELSE list_filter(ls, lambda x, j: NOT list_contains(nos, j - 1)) END, chr(10)) END AS text FROM t LEFT JOIN g ON t.r = g.r
"""

OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2) q JOIN n l ON l.doc_id = a JOIN n r ON r.doc_id = b WHERE 100 * shared >= 85 * (l.n + r.n - shared)),
c AS (SELECT doc_id AS src, doc_id AS dst FROM documents UNION SELECT c.src, p.b FROM c JOIN p ON c.dst = p.a),
m AS (SELECT src, min(dst) AS component_id FROM c GROUP BY src)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, m.component_id = w.doc_id AS kept FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.src = w.doc_id
"""

OP8 = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) >= 0.98::DOUBLE * sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a),
c AS (SELECT vec_id AS src, vec_id AS dst FROM v UNION SELECT c.src, p.b FROM c JOIN p ON c.dst = p.a),
m AS (SELECT src, min(dst) AS component_id FROM c GROUP BY src)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.component_id, m.component_id = v.vec_id AS kept FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN m ON m.src = v.vec_id
"""

OP10 = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
k AS (SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(ws[i:i + 9], ' ') AS k FROM (SELECT item, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM b WHERE len(ws) > 0)),
g AS (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM k) WHERE len(ws) >= n)),
h AS (SELECT g.r, g.i, g.n, k.item FROM g JOIN k ON g.n = k.n AND g.k = k.k),
p AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit > 0, FALSE) AS contaminated FROM w LEFT JOIN p ON w.r = p.r LEFT JOIN m ON w.r = m.r
"""

OP11 = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
g AS (SELECT r, i, md5(b[i:i + 199]) AS k FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS i FROM t WHERE octet_length(b) >= 200)),
d AS (SELECT r, i FROM g WHERE k IN (SELECT k FROM g GROUP BY k HAVING count(*) > 1)),
f AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200, TRUE) AS fresh FROM d),
n AS (SELECT r, i, sum(fresh::INT) OVER (PARTITION BY r ORDER BY i) AS no FROM f),
s AS (SELECT r, no, min(i) AS a, max(i) + 200 AS e FROM n GROUP BY r, no),
p AS (SELECT r, sum(e - a)::BIGINT AS gone, count(*) AS spans, list(a ORDER BY a) AS starts, list(e ORDER BY a) AS ends FROM s GROUP BY r)
SELECT t.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(CASE WHEN p.r IS NULL THEN b ELSE list_reduce(list_transform(range(1, len(starts) + 2), lambda j: b[(CASE WHEN j = 1 THEN 1 ELSE ends[j - 1] END):(CASE WHEN j > len(starts) THEN octet_length(b) ELSE starts[j] - 1 END)]), lambda x, y: x || y) END) AS kept_sha256 FROM t LEFT JOIN p ON t.r = p.r
"""

OP13 = r"""
WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
x AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
l AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM x WHERE length(run) >= 5 GROUP BY 1, 2),
y AS (SELECT run, n, hex(encode(id || ':' || run)) AS h FROM l),
z AS (SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda a, b: xor(a >> 8, crc[xor(a, b) % 256 + 1]))) AS h FROM y, c),
w AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM z) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
k AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
q AS (SELECT a.word, b.word AS other, b.n AS m FROM k a JOIN k b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT w.word, k.word, k.n FROM w JOIN k ON k.rest = w.word UNION SELECT k.word, w.word, w.n FROM w JOIN k ON k.rest = w.word),
o AS (SELECT word, count(*) AS n_near, max(m) AS most FROM q GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * n THEN (SELECT min(other) FROM q WHERE q.word = w.word AND q.m = o.most) END AS form, CASE WHEN most >= 2 * n THEN most END AS form_n FROM w LEFT JOIN o ON w.word = o.word),
r AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, r.root FROM f JOIN r ON f.form = r.word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON f.word = r.word
"""

ORACLES = {
    "op3_substring_dedup": OP3,
    "op6_line_dedup": OP6,
    "op7_minhash_near_dedup": OP7,
    "op8_embedding_near_dedup": OP8,
    "op10_decontamination": OP10,
    "op11_suffix_array_dedup": OP11,
    "op13_spelling_variants": OP13,
}
