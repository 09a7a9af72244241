"""DuckDB SQL for the rows of the queries that SQL can express."""

OP1 = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d),
r AS (SELECT *, payload_bytes >= 1000 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to FROM r
"""

OP2 = r"""
WITH RECURSIVE
lowered AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM lowered),
sized AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, s FROM sets),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS rep, any_value(n_shingles) AS n FROM sized WHERE n_shingles > 0 GROUP BY list_sort(s)),
members AS (SELECT z.doc_id, c.rep FROM sized z JOIN classes c ON list_sort(z.s) = c.s),
grams AS (SELECT rep, n, unnest(s) AS g FROM classes),
meets AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM grams a JOIN grams b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep),
links AS (SELECT a, b FROM meets WHERE 100 * shared >= 85 * (na + nb - shared)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
walk(a, b) AS (SELECT rep, rep FROM classes UNION SELECT w.a, e.b FROM walk w JOIN both_ways e ON w.b = e.a),
groups AS (SELECT a AS rep, min(b) AS component FROM walk GROUP BY a)
SELECT z.doc_id, z.n_shingles, coalesce(g.component, z.doc_id) AS component_id,
  z.doc_id = coalesce(g.component, z.doc_id) AS kept
FROM sized z LEFT JOIN members m ON z.doc_id = m.doc_id LEFT JOIN groups g ON m.rep = g.rep
"""

OP3 = r"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
rows_ AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
  xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM documents, crc),
sums AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS LAST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM rows_),
cut AS (SELECT *, least(15, ((2 * before + size) * 16) // (2 * total)) AS shard FROM sums)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY before) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut
"""

OP4 = r"""
WITH RECURSIVE rows_ AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#17'), 1, 13) AS BIGINT) AS spot FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM rows_ GROUP BY source),
fill(step, pos, s, w, capped, target) AS (
  SELECT 0, pos, source_size, CAST(CASE pos % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE), FALSE, CAST(0 AS DOUBLE) FROM totals
  UNION ALL
  SELECT step + 1, pos, s, w, capped OR t > 2 * s, t FROM (
    SELECT *, CASE WHEN capped THEN CAST(2 * s AS DOUBLE)
      ELSE (CAST(150 * sum(s) OVER () - 200 * coalesce(sum(s) FILTER (capped) OVER (), 0) AS DOUBLE) / 100) * w / sum(w) FILTER (NOT capped) OVER () END AS t
    FROM fill WHERE step <= (SELECT count(*) FROM totals))),
goals AS (SELECT t.source, t.source_size, t.n, f.target, least(CAST(round_even(f.target, 0) AS BIGINT), 2 * t.source_size) AS words
  FROM totals t JOIN fill f ON t.pos = f.pos WHERE f.step = (SELECT count(*) + 1 FROM totals)),
plans AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(2, words // source_size) END AS passes FROM goals),
runs AS (SELECT r.doc_id, r.size, p.source_size, p.target, p.passes, p.words - p.passes * p.source_size AS rest,
  sum(r.size) OVER (PARTITION BY r.source ORDER BY r.spot, r.doc_id, r.size ROWS UNBOUNDED PRECEDING) - r.size AS before
  FROM rows_ r JOIN plans p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM runs
"""

OP6 = r"""
WITH usable AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP12 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS k FROM t),
f AS (SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR k[3] % 100 >= 90 THEN 'plain' WHEN k[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(text, 1, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""

OP13 = r"""
WITH RECURSIVE
crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (SELECT run, k, xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM counted, crc),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
holes AS (SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM words, range(10000) r(i) WHERE i < length(word)),
replaced AS (SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word),
grown AS (SELECT DISTINCT w.word, w.n, x.word AS near, x.n AS near_n FROM words w JOIN holes x ON w.word = x.a || x.b),
near AS (SELECT * FROM replaced UNION ALL SELECT * FROM grown UNION ALL SELECT near, near_n, word, n FROM grown),
met AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY word),
best AS (SELECT m.word, m.n_near, m.top, min(e.near) AS near FROM met m JOIN near e ON m.word = e.word AND m.top = e.near_n GROUP BY m.word, m.n_near, m.top),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 5 * w.n THEN b.near END AS form, CASE WHEN b.top >= 5 * w.n THEN b.top END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
walk(word, tip) AS (SELECT word, word FROM forms UNION ALL SELECT k.word, f.form FROM walk k JOIN forms f ON k.tip = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT k.word, k.tip AS root FROM walk k JOIN forms f ON k.tip = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM forms f JOIN ends e ON f.word = e.word
"""

ORACLES = {
    "op1_warc_dictionary": OP1,
    "op2_minhash_near_dedup": OP2,
    "op3_prefix_sum_shards": OP3,
    "op4_hypergeometric_mix": OP4,
    "op6_exact_topk": OP6,
    "op12_fill_in_middle": OP12,
    "op13_spelling_variants": OP13,
}
